"""Parameter search, CV evaluation, refit and forward feature tests.

Fits and metrics are distributed jobs; the driver only holds the parameter
candidates and one number per (candidate, run).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.operators.decode import decode_cdf, decode_cut
from ordlab.operators.metrics import qwk
from ordlab.operators.models import KappaEvaluator
from ordlab.operators.rank import position
from ordlab.operators.split import kfold


def param_search(df: DataFrame, features, label: str, id_col: str, estimator, grid: dict,
                 folds: int = 3, cuts=None, parallelism: int = 2) -> DataFrame:
    """Every grid point cross-validated on hash folds (``foldCol``) with
    the kappa evaluator; returns the trial log
    ``(trial, <param>..., kappa_mean, kappa_std)``."""
    spark = df.sparkSession
    d = kfold(df, id_col, folds, "fold")
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    pipe = Pipeline(stages=[va, estimator])
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    maps = b.build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                        evaluator=KappaEvaluator(labelCol=label, cuts=cuts or []),
                        foldCol="fold", parallelism=parallelism, collectSubModels=False)
    m = cv.fit(d)
    rows = []
    for i, (pm, mean, std) in enumerate(zip(maps, m.avgMetrics, m.stdMetrics)):
        vals = {p.name: float(v) for p, v in pm.items()}
        rows.append((i, *[vals[n] for n in grid], float(mean), float(std)))
    schema = "trial int, " + ", ".join(f"{n} double" for n in grid) + ", kappa_mean double, kappa_std double"
    return spark.createDataFrame(rows, schema)


def cv_evaluate(df: DataFrame, folds: DataFrame, features, label: str, id_col: str, make_estimator,
                decoder: str = "cut", cuts=None, parallelism: int = 2) -> DataFrame:
    """One setting over stored folds ``(run, id, role)``: fit on each run's
    train part, predict its test part, decode (cut points or the train CDF),
    QWK per run.  Runs are fitted by ``parallelism`` concurrent Spark jobs (as
    ``CrossValidator(parallelism=...)``).  Returns ``(run, kappa)``."""
    from concurrent.futures import ThreadPoolExecutor
    from ordlab.operators.profile import class_cdf
    runs = [r[0] for r in folds.select("run").distinct().orderBy("run").collect()]  # run numbers only
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    j = df.join(folds.withColumnRenamed("id", id_col), id_col)

    def one_run(r):
        tr = j.filter((F.col("run") == r) & (F.col("role") == "train"))
        te = j.filter((F.col("run") == r) & (F.col("role") == "test"))
        model = Pipeline(stages=[va, make_estimator()]).fit(tr)
        pred = model.transform(te).select("run", id_col, label, "prediction")
        if decoder == "cut":
            dec = pred.withColumn("cls", decode_cut("prediction", cuts))
        else:
            dec = decode_cdf(pred.withColumnRenamed(id_col, "__id"), "prediction", "__id",
                             class_cdf(tr, label, by=["run"]), by=["run"], out="cls")
        return qwk(dec, label, "cls", by=["run"])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(one_run, runs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refit_predict(train: DataFrame, test: DataFrame, features, label: str, id_col: str, make_estimator,
                  cuts) -> DataFrame:
    """Refit on all train rows, predict test; the prediction table
    carries the raw score, its rank, the CDF-decoded and the cut-decoded class."""
    from ordlab.operators.profile import class_cdf
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    model = Pipeline(stages=[va, make_estimator()]).fit(train)
    pred = model.transform(test).select(id_col, F.col("prediction").alias("raw"))
    ranked = position(pred, ["raw", id_col], "rank")
    dec = decode_cdf(ranked, "raw", id_col, class_cdf(train, label), out="class_cdf")
    return dec.select(id_col, "raw", "rank", "class_cdf", decode_cut("raw", cuts).alias("class_cut"))


def forward_feature_test(df: DataFrame, folds: DataFrame, base, candidates, label: str, id_col: str,
                         make_estimator, cuts) -> DataFrame:
    """Base set plus one candidate at a time; mean QWK over runs per candidate."""
    spark = df.sparkSession
    rows = []
    for cand in candidates:
        k = cv_evaluate(df, folds, list(base) + [cand], label, id_col, make_estimator, "cut", cuts)
        r = k.agg(F.avg("kappa").alias("m"), F.stddev_pop("kappa").alias("s")).first()
        rows.append((cand, float(r["m"]), float(r["s"])))
    return spark.createDataFrame(rows, "feature string, kappa_mean double, kappa_std double")


def gram_table(df: DataFrame, folds: DataFrame, features, label: str, id_col: str) -> DataFrame:
    """One aggregate for all runs: row count, means and the population
    covariances of features and label over each run's train rows that are complete."""
    names = [*features, label]
    j = df.join(folds.filter(F.col("role") == "train").withColumnRenamed("id", id_col), id_col)
    ok = F.lit(True)
    for x in names:
        ok = ok & F.col(x).isNotNull()
    v = [F.when(ok, F.col(x).cast("double")) for x in names]
    aggs = [F.count(v[0]).alias("n"), F.array(*[F.avg(x) for x in v]).alias("mean")]
    aggs += [F.array(*[F.covar_pop(v[a], v[b]) for a in range(len(v)) for b in range(a, len(v))]).alias("cov")]
    return j.groupBy("run").agg(*aggs)


def add_one_fits(gram: DataFrame, features, base, candidates, l2: float = 0.0) -> list[tuple]:
    """Least-squares fits (ridge with ``l2`` on the covariances) of the base set
    plus one candidate, for every run of a ``gram_table``: the base block is solved
    once, and each candidate by the border of one row and column.  Returns ``(run,
    candidate, intercept, coefficients by feature)``; a candidate that the base set
    determines gets coefficient 0.  Runs and candidates are parameters, so is this."""
    import numpy as np
    features = list(features)
    k = len(features) + 1
    out = []
    for r in gram.orderBy("run").collect():  # one row per run
        cov = np.zeros((k, k))
        cov[np.triu_indices(k)] = [np.nan if x is None else x for x in r["cov"]]
        cov = cov + np.triu(cov, 1).T
        mean = np.array([np.nan if x is None else x for x in r["mean"]])
        b = [features.index(x) for x in base]
        block = cov[np.ix_(b, b)] + l2 * np.eye(len(b))
        inverse = np.linalg.pinv(block) if b else np.zeros((0, 0))
        alone = inverse @ cov[b, -1]
        for cand in candidates:
            c_ = features.index(cand)
            side = cov[b, c_]
            through = inverse @ side
            rest = cov[c_, c_] + l2 - side @ through
            w = (cov[c_, -1] - side @ alone) / rest if rest > 1e-12 * max(cov[c_, c_], 1e-300) else 0.0
            coef = dict(zip(base, alone - through * w)) | {cand: w}
            out.append((r["run"], cand, float(mean[-1] - sum(v * mean[features.index(x)] for x, v in coef.items())),
                        {x: float(v) for x, v in coef.items()}))
    return out


def forward_linear_test(df: DataFrame, folds: DataFrame, base, candidates, label: str, id_col: str, cuts, l2: float = 0.0) -> DataFrame:
    """X6 for a linear learner: every candidate's kappa from one aggregate and one
    scoring job, ``(feature, kappa_mean, kappa_std)``; the number of fits that read
    rows does not depend on the number of candidates."""
    spark = df.sparkSession
    base, candidates = list(base), list(candidates)
    feats = base + [x for x in candidates if x not in base]
    fits = add_one_fits(gram_table(df, folds, feats, label, id_col), feats, base, candidates, l2)
    rows = [(run, cand, icept, [coef.get(x, 0.0) for x in feats]) for run, cand, icept, coef in fits]
    table = spark.createDataFrame(rows, "run int, feature string, icept double, coef array<double>")
    per = table.groupBy("run").agg(F.collect_list(F.struct("feature", "icept", "coef")).alias("fits"))  # candidates per run
    test = df.join(folds.filter(F.col("role") == "test").withColumnRenamed("id", id_col), id_col).join(F.broadcast(per), "run")
    d = test.select("run", F.col(label).alias("__y"), F.array(*[F.col(x).cast("double") for x in feats]).alias("x"), F.explode("fits").alias("f"))
    score = F.aggregate(F.zip_with("x", "f.coef", lambda a, w: a * w), F.col("f.icept"), lambda s, v: s + v)
    d = d.select("run", "__y", F.col("f.feature").alias("feature"), score.alias("s")).withColumn("cls", decode_cut("s", cuts))
    return qwk(d, "__y", "cls", by=["run", "feature"]).groupBy("feature").agg(
        F.avg("kappa").alias("kappa_mean"), F.stddev_pop("kappa").alias("kappa_std"))
