"""Trees on random thresholds.

Each tree draws seeded cuts inside every feature's measured range; a row's bin is the
number of cuts below its value, and one stock tree with a random feature subset
per split is fitted to the bins of all rows (no bootstrap).  A split between
two bins is a split at the cut between them, so every threshold of a tree is one
of its random cuts.  The trees are applied as column expressions and averaged.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.functions.scalar import c
from ordlab.operators.boosting import MISSING, Leaf, Split, tree_column
from ordlab.session import materialize


@dataclass
class ExtraTrees:
    trees: list
    cuts: list[dict[str, list[float]]]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Mean of the trees; a tree is a column of its own, so that expressions stay small."""
        if not self.trees:
            return df.withColumn(out, F.lit(None).cast("double"))
        names = [f"__tree{i}" for i in range(len(self.trees))]
        d = df.select("*", *[tree_column(t, 1).alias(n) for n, t in zip(names, self.trees)])
        return d.withColumn(out, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def _bin(x: str, cuts: list[float]) -> Column:
    """Number of cuts below the value; what is missing lies above all."""
    v = F.col(x).cast("double")
    v = F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).otherwise(v)
    return F.size(F.filter(F.array(*[F.lit(k) for k in cuts]), lambda k: k < v)).cast("double")


def extra_trees(df: DataFrame, features, label: str, trees: int = 50, cuts: int = 31, depth: int = 8, feature_share: float = 1.0,
                min_rows: int = 1, seed: int = 1, parallelism: int = 4) -> ExtraTrees:
    """Fit ``trees`` trees with ``cuts`` random cuts per feature.  Rows with a null
    label are left out; a feature without a range has no cuts."""
    features = list(features)
    rows = materialize(df.filter(c(label).isNotNull()).select(*features, c(label).cast("double").alias("__y")), "extra-rows")
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))).alias(f"{k}{i}")
                                                    for i, x in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return ExtraTrees([], [])
    ranges = {x: (ends[f"lo{i}"], ends[f"hi{i}"]) for i, x in enumerate(features)}

    def one(t: int):
        rng = np.random.default_rng([seed, t])
        drawn = {x: sorted(float(v) for v in rng.uniform(lo, hi, cuts)) if lo is not None and lo < hi else [] for x, (lo, hi) in ranges.items()}
        used = [x for x in features if drawn[x]]
        if not used:
            return Leaf(float(rows.agg(F.avg("__y")).first()[0])), drawn
        binned = rows.select("__y", *[_bin(x, drawn[x]).alias(x) for x in used])
        data = VectorAssembler(inputCols=used, outputCol="features").transform(binned)
        forest = RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=1, bootstrap=False, maxDepth=depth, maxBins=cuts + 2,
                                       featureSubsetStrategy=str(float(feature_share)), minInstancesPerNode=min_rows, seed=seed * 7919 + t).fit(data)

        def walk(node):
            if node.getClass().getSimpleName() == "LeafNode":
                return Leaf(float(node.prediction()))
            s = node.split()
            x = used[s.featureIndex()]  # bins up to floor(threshold) go left: values up to that cut
            return Split(x, drawn[x][int(np.floor(s.threshold()))], walk(node.leftChild()), walk(node.rightChild()))

        return walk(forest.trees[0]._java_obj.rootNode()), drawn

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = list(pool.map(one, range(trees)))
    return ExtraTrees([t for t, _ in fitted], [d for _, d in fitted])
