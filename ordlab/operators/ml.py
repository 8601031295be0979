"""UD4: fit/transform operators as persistable ``pyspark.ml`` stages.

``PopulationScaler`` (E13: population std, unlike ``StandardScaler``), the
right-closed ``CutDecoder`` (D2: unlike ``Bucketizer``, bins are ``(a, b]``)
and ``CutRefitKappaEvaluator`` (M16).  Fitted state is model-sized (one mean
and std per column) and persists with ``DefaultParamsWritable`` (S13).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F


class _ScalerParams(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / std_pop`` with moments of the fitting frame (train)."""

    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(inputCols=list(inputCols or []), outputCols=list(outputCols or []))

    def _fit(self, dataset):
        cols = self.getInputCols()
        r = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        model = PopulationScalerModel()
        model._set(inputCols=cols, outputCols=self.getOutputCols() or [f"{c}_z" for c in cols],
                   means=[float(r[f"m{i}"]) for i in range(len(cols))],
                   stds=[float(r[f"s{i}"] or 0.0) for i in range(len(cols))])
        return model


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset):
        out = {}
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"),
                              self.getOrDefault("stds")):
            out[o] = (F.col(c) - F.lit(m)) / F.nullif(F.lit(s), F.lit(0.0))
        return dataset.withColumns(out)


class CutDecoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """D2 as a stage: ``1 + sum_k [score > c_k]`` (right-closed bins)."""

    inputCol = Param(Params._dummy(), "inputCol", "score column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "class column", typeConverter=TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points", typeConverter=TypeConverters.toListFloat)

    def __init__(self, inputCol="prediction", outputCol="class", cuts=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, cuts=list(cuts or []))

    def _transform(self, dataset):
        from ordlab.operators.decode import decode_cut
        return dataset.withColumn(self.getOrDefault("outputCol"),
                                  decode_cut(self.getOrDefault("inputCol"), self.getOrDefault("cuts")))


class CutRefitKappaEvaluator(Evaluator):
    """Fit cut points on the evaluated frame (X1 coordinate search from
    ``start``), then report the QWK of the refitted decode."""

    def __init__(self, predictionCol="prediction", labelCol="label", start=None, min_step=0.0625):
        super().__init__()
        self.predictionCol, self.labelCol = predictionCol, labelCol
        self.start = list(start or [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5])
        self.min_step = min_step

    def _evaluate(self, dataset):
        from ordlab.operators.cutpoints import fit_cutpoints
        _, k = fit_cutpoints(dataset, self.predictionCol, self.labelCol, self.start, min_step=self.min_step)
        return float(k)

    def isLargerBetter(self):
        return True
