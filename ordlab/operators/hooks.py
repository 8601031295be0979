"""Evaluation hooks (M14, UD2, UD3): the negative kappa of decoded scores.

A hook decodes raw learner outputs the way its objective does and returns -QWK,
so that a smaller value is better, for early stopping and parameter search.

=========== ============================== =======================================
kind        score column                   class
=========== ============================== =======================================
cut         a number                       right-closed bins of ``cuts`` (D2)
round       a number                       D7
cdf         a number                       CDF decode (D1); also pairwise ranking
softmax     class probabilities            expected class, CDF decode (D4)
softkappa   raw class scores               softmax first, then as ``softmax``
ebc         raw threshold scores           sigmoid, 1 + their sum, CDF decode (D5)
ebc_hard    raw threshold scores           1 + the number of positive ones (D5)
cocr        raw class scores               1 + their sum (D6), CDF decode
=========== ============================== =======================================
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c, expected_class, sigmoid, softmax
from ordlab.operators import decode as dc
from ordlab.operators.metrics import qwk

KINDS = ("cut", "round", "cdf", "softmax", "softkappa", "ebc", "ebc_hard", "cocr")


def decode_kind(df: DataFrame, kind: str, score: str, id_col: str, cdf: DataFrame | None = None, cuts=None, by=None,
                out: str = "cls", n_classes: int = 8, cdf_by=None) -> DataFrame:
    """Add the class ``out`` that the hook ``kind`` gives the raw output ``score``."""
    if kind == "cut":
        return df.withColumn(out, dc.decode_cut(score, cuts))
    if kind == "round":
        return df.withColumn(out, dc.decode_round(score))
    if kind == "ebc_hard":
        return df.withColumn(out, dc.decode_ebc(score, hard=True, n_thresholds=n_classes - 1))
    if kind == "cdf":
        value = c(score).cast("double")
    elif kind == "softmax":
        value = expected_class(score)
    elif kind == "softkappa":
        value = None
    elif kind == "ebc":
        value = dc.decode_ebc(F.transform(c(score), sigmoid), n_thresholds=n_classes - 1)
    elif kind == "cocr":
        value = dc.decode_cocr(score)
    else:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if value is None:  # a column between the two steps keeps the expressions small
        d = df.withColumn("__p", softmax(score, n_classes)).withColumn("__ev", expected_class("__p")).drop("__p")
    else:
        d = df.withColumn("__ev", value)
    return dc.decode_cdf(d, "__ev", id_col, cdf, by=by, out=out, n_classes=n_classes, cdf_by=cdf_by).drop("__ev")


def kappa_hook(kind: str, label: str, score: str, id_col: str, cdf: DataFrame | None = None, cuts=None,
               n_classes: int = 8) -> Callable[[DataFrame], float]:
    """The hook as a function of scored rows; no value (NaN) if the kappa has none."""
    def hook(df: DataFrame) -> float:
        d = decode_kind(df, kind, score, id_col, cdf, cuts, out="__cls", n_classes=n_classes)
        k = qwk(d, label, "__cls").first()[0]
        return float("nan") if k is None else -float(k)

    return hook


class HookEvaluator(Evaluator):
    """A hook as a ``pyspark.ml`` evaluator (the kappa itself; larger is better)."""

    @keyword_only
    def __init__(self, *, kind, labelCol, scoreCol, idCol, cdf=None, cuts=None, nClasses=8):
        super().__init__()
        self.hook = kappa_hook(kind, labelCol, scoreCol, idCol, cdf, cuts, nClasses)

    def _evaluate(self, dataset: DataFrame) -> float:
        return -self.hook(dataset)

    def isLargerBetter(self) -> bool:
        return True
