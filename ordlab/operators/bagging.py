"""Bagged greedy selection and the model-library chain.

Each bag is a seeded subset of the model pool.  The blends of all bags
and the predictions of the pool are columns of one table with a row per (run, id), so a
round scores every (bag, model, weight) in one job without a join or a shuffle of rows:
candidates are an explode, and boundaries are found by ``orderstats``.  A candidate's weight is a
share of the blend's weight, so the new blend is ``(blend + w p) / (1 + w)``.
A bag is done when none of its candidates raises its mean kappa.

On the driver: the pool (models per bag) and one winner per bag and round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlab.operators.decode import decode_cdf, decode_cut
from ordlab.operators.ensemble import candidate_scores, top_k_per_group
from ordlab.operators.metrics import qwk
from ordlab.session import fitted, materialize, shuffle_partitions


def draw_bags(models: list[str], bags: int, fraction: float = 1.0, replacement: bool = True, seed: int = 2015) -> list[list[str]]:
    """Members of each bag, best models first (``models`` is in that order).  With
    replacement ``int(fraction * n)`` draws, of which a model may get several;
    without, each model with probability ``fraction``."""
    out = []
    for bag in range(bags):
        rng = np.random.RandomState(seed + 100 * bag)
        if replacement:
            picked = sorted(rng.randint(len(models), size=int(len(models) * fraction)))
        else:
            picked = np.flatnonzero(rng.uniform(size=len(models)) < fraction)
        out.append([models[i] for i in picked])
    return out


def _meet(preds: DataFrame, members: DataFrame, blend: DataFrame) -> DataFrame:
    """Members' predictions beside their bag's blend, written once per round."""
    pool = preds.join(F.broadcast(members), "model")  # one row per bag and model: bounded by the pool
    pool = pool.repartition(shuffle_partitions(preds.sparkSession), "bag", "run", "id")
    return materialize(pool.join(blend, ["bag", "run", "id"]), "bags")


def _kappas(cand: DataFrame, key, cdf: DataFrame) -> DataFrame:
    """Mean kappa over runs of the blends ``key + [run, id, blend, target]``."""
    by = [*key, "run"]
    dec = decode_cdf(cand.select(*by, "id", "blend", "target"), "blend", "id", cdf, by=by, out="cls", cdf_by=["run"])
    return qwk(dec, "target", "cls", by=by).groupBy(*key).agg(F.avg("kappa").alias("kappa_mean"))


def _scores(met: DataFrame, weights, cdf: DataFrame) -> DataFrame:
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight")
    cand = met.select("bag", "model", "run", "id", "target", "prediction", "blend", w)
    cand = cand.withColumn("blend", (F.col("blend") + F.col("weight") * F.col("prediction")) / (F.lit(1.0) + F.col("weight")))
    return _kappas(cand, ["bag", "model", "weight"], cdf)


def bag_candidate_scores(preds: DataFrame, members: DataFrame, blend: DataFrame, weights, cdf: DataFrame) -> DataFrame:
    """N6 for all bags at once: ``(bag, model, weight, kappa_mean)``.

    ``preds``: ``(model, run, id, prediction, target)``; ``members``: ``(bag,
    model)``; ``blend``: ``(bag, run, id, blend)``; ``cdf``: ``(run, cls, cdf)``;
    ``weights``: shares of the blend's weight above -1."""
    return _scores(_meet(preds, members, blend), weights, cdf)


@dataclass
class Selection:
    """Chosen models and absolute weights per bag, and the bags' final blends."""
    chosen: list[list[tuple[str, float]]]
    blends: DataFrame
    kappas: list[list[float]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        rows = [(b, i, m, float(w)) for b, c in enumerate(self.chosen) for i, (m, w) in enumerate(c)]
        return spark.createDataFrame(rows, "bag int, step int, model string, weight double")


def start_blends(preds: DataFrame, starts: list[list[str]]) -> DataFrame:
    """Mean of each bag's first models (a model named twice counts twice)."""
    count = {}
    for b, names in enumerate(starts):
        for m in names:
            count[b, m] = count.get((b, m), 0) + 1
    rows = [(b, m, float(n)) for (b, m), n in count.items()]
    spark = preds.sparkSession
    t = spark.createDataFrame(rows, "bag int, model string, __w double")
    return preds.join(F.broadcast(t), "model").groupBy("bag", "run", "id").agg(
        (F.sum(F.col("__w") * F.col("prediction")) / F.sum("__w")).alias("blend"))


def _wide(preds: DataFrame, pool: list[str], starts: list[list[str]]) -> DataFrame:
    """One row per run and id: the target, each model's prediction ``p`` and whether it has one
    (``h``), the mean of each bag's first models ``b`` and whether there is one (``a``)."""
    aggs = [F.max("target").alias("target")]
    for i, m in enumerate(pool):
        mine = F.col("model") == m
        aggs += [F.max(F.when(mine, F.col("prediction"))).alias(f"p{i}"), F.max(mine).alias(f"h{i}")]
    rows = preds.filter(F.col("model").isin(pool)).groupBy("run", "id").agg(*aggs)
    blends = {}
    for b, names in enumerate(starts):
        first = [(pool.index(m), float(names.count(m))) for m in sorted(set(names))]
        total = sum((F.coalesce(F.lit(w) * F.col(f"p{i}"), F.lit(0.0)) for i, w in first), F.lit(0.0))
        some = F.coalesce(*[F.col(f"p{i}") for i, _ in first]).isNotNull()
        weight = sum((F.when(F.col(f"h{i}"), F.lit(w)).otherwise(0.0) for i, w in first), F.lit(0.0))
        blends |= {f"b{b}": F.when(some, total / weight), f"a{b}": weight > 0}
    return rows.withColumns(blends)


def _exploded(rows: DataFrame, columns: list[tuple], number: str) -> DataFrame:
    """A row ``(run, id, target, number, blend)`` per row and ``(blend, has one)``."""
    blends = F.array(*[F.when(has, x) for x, has in columns])
    r = rows.select("run", "id", "target", F.array(*[has for _, has in columns]).alias("__has"), F.posexplode(blends).alias(number, "blend"))
    return r.filter(F.col("blend").isNotNull() | F.get("__has", F.col(number))).drop("__has")


def bagged_selection(preds: DataFrame, cdf: DataFrame, bags: int = 5, fraction: float = 1.0, replacement: bool = True,
                     init_top_k: int = 1, weights=(0.25, 0.5, 1.0), tol: float = 1e-9, seed: int = 2015) -> Selection:
    """Greedy selection with replacement inside each bag (see the module text)."""
    spark = preds.sparkSession
    singles = candidate_scores(preds, None, 0.0, [1.0], cdf)
    ranked = [r["model"] for r in singles.orderBy(F.desc("kappa_mean"), "model").collect()]  # one row per model
    drawn = [d or ranked[:1] for d in draw_bags(ranked, bags, fraction, replacement, seed)]
    starts = [d[:max(init_top_k, 1)] for d in drawn]
    chosen = [[(m, 1.0) for m in s] for s in starts]
    total = [float(len(s)) for s in starts]
    pool = sorted({m for d in drawn for m in d})
    cdf = fitted(cdf)  # every decode of every round reads it
    rows = materialize(_wide(preds, pool, starts), "bags")
    own = _exploded(rows, [(F.col(f"b{b}"), F.col(f"a{b}")) for b in range(bags)], "bag")
    first = _kappas(own, ["bag"], cdf).withColumnRenamed("kappa_mean", "k").collect()
    best = {r["bag"]: r["k"] if r["k"] is not None else float("-inf") for r in first}
    kappas = [[float(best.get(b, float("-inf")))] for b in range(bags)]
    going = set(range(bags))
    while going:
        cands = [(b, i, float(x)) for b in sorted(going) for i, m in enumerate(pool) if m in drawn[b] for x in weights]
        blends = [((F.col(f"b{b}") + F.lit(x) * F.col(f"p{i}")) / F.lit(1.0 + x), F.col(f"a{b}") & F.col(f"h{i}")) for b, i, x in cands]
        names = spark.createDataFrame([(n, b, pool[i], x) for n, (b, i, x) in enumerate(cands)], "cand int, bag int, model string, weight double")
        scores = _kappas(_exploded(rows, blends, "cand"), ["cand"], cdf).join(F.broadcast(names), "cand")  # one row per candidate
        w = Window.partitionBy("bag").orderBy(F.desc_nulls_last("kappa_mean"), "model", "weight")  # candidates of a bag
        top = scores.withColumn("r", F.row_number().over(w)).filter("r = 1").collect()
        wins = [r for r in top if r["kappa_mean"] is not None and r["kappa_mean"] > best[r["bag"]] + tol]
        going, now = {r["bag"] for r in wins}, {}
        for r in wins:
            b, i, x = r["bag"], pool.index(r["model"]), r["weight"]
            chosen[b].append((r["model"], x * total[b]))
            total[b] *= 1.0 + x
            best[b] = float(r["kappa_mean"])
            kappas[b].append(best[b])
            now |= {f"b{b}": (F.col(f"b{b}") + F.lit(x) * F.col(f"p{i}")) / F.lit(1.0 + x), f"a{b}": F.col(f"a{b}") & F.col(f"h{i}")}
        if now:
            rows = materialize(rows.withColumns(now), "bags")
    out = _exploded(rows, [(F.col(f"b{b}"), F.col(f"a{b}")) for b in range(bags)], "bag")
    return Selection(chosen, materialize(out.select("bag", "run", "id", "blend"), "blends"), kappas)


def bag_progress(selection: Selection, truth: DataFrame, cdf: DataFrame, n_classes: int = 8) -> tuple[DataFrame, DataFrame]:
    """After each bag the kappa of the mean of the bags so far, ``(bags, kappa_mean,
    kappa_std)``, and the cut-offs ``(bags, k, cut)``: the greatest score of
    classes 1..k by the CDF, averaged over runs.  ``truth``: ``(run, id, target)``."""
    w = Window.partitionBy("run", "id").orderBy("bag").rowsBetween(Window.unboundedPreceding, 0)  # bags of one row
    mean = materialize(selection.blends.select("run", "id", (F.col("bag") + 1).alias("bags"), F.avg("blend").over(w).alias("s"))
                       .join(truth, ["run", "id"]), "progress")
    key = ["bags", "run"]
    k = qwk(decode_cdf(mean, "s", "id", cdf, by=key, out="cls", cdf_by=["run"], n_classes=n_classes), "target", "cls", by=key)
    k = k.groupBy("bags").agg(F.avg("kappa").alias("kappa_mean"), F.stddev_pop("kappa").alias("kappa_std"))
    closed = decode_cdf(mean, "s", "id", cdf, by=key, out="cls", cdf_by=["run"], n_classes=n_classes, strict=False)
    tops = closed.groupBy(*key).agg(*[F.max(F.when(F.col("cls") <= j, F.col("s"))).alias(str(j)) for j in range(1, n_classes)])
    tops = tops.select(*key, F.explode(F.array(*[F.struct(F.lit(j).alias("k"), F.col(str(j)).alias("cut")) for j in range(1, n_classes)])).alias("x"))
    return k, tops.groupBy("bags", F.col("x.k").alias("k")).agg(F.avg("x.cut").alias("cut"))


def apply_selection(chosen: DataFrame, preds: DataFrame, key=("id",)) -> DataFrame:
    """The mean over bags of each bag's weighted blend of test predictions
    ``key + [model, prediction]``, as ``key + [blend]``."""
    w = chosen.groupBy("bag", "model").agg(F.sum("weight").alias("__w"))
    per_bag = preds.join(F.broadcast(w), "model").groupBy(*key, "bag").agg(  # one row per bag and model
        (F.sum(F.col("__w") * F.col("prediction")) / F.sum("__w")).alias("blend"))
    return per_bag.groupBy(*key).agg(F.avg("blend").alias("blend"))


def library_ensemble(trials: DataFrame, preds: DataFrame, test: DataFrame, cdf: DataFrame, test_cdf: DataFrame, per_family: int = 10,
                     n_classes: int = 8, **selection) -> tuple[DataFrame, Selection]:
    """The best ``per_family`` trials of each family of the trial log ``(family,
    trial, kappa_mean)`` are the model pool, the pool is selected in bags, and the
    selection is applied to the test predictions, decoded by CDF and by the cut-offs.

    ``preds`` and ``test`` name models ``family@trial``.  Returns ``(id, blend, cls_cdf,
    cls_cut)`` and the selection."""
    pool = top_k_per_group(trials, ["family"], "kappa_mean", per_family, "trial").select(
        F.concat_ws("@", "family", F.col("trial").cast("string")).alias("model"))
    mine = materialize(preds.join(fitted(pool), "model", "left_semi"), "pool")
    cdf = fitted(cdf)
    sel = bagged_selection(mine, cdf, **selection)
    blend = materialize(apply_selection(sel.table(preds.sparkSession), test), "blend")  # the decode reads it several times
    _, cuts = bag_progress(sel, mine.select("run", "id", "target").distinct(), cdf, n_classes)
    last = cuts.filter(F.col("bags") == len(sel.chosen)).orderBy("k").collect()  # a cut per class
    out = decode_cdf(blend, "blend", "id", fitted(test_cdf), out="cls_cdf", n_classes=n_classes)
    return out.withColumn("cls_cut", decode_cut("blend", [r["cut"] for r in last if r["cut"] is not None])), sel
