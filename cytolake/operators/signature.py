"""Biomarker panels and their models, with Spark's own learners."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_panel(res: DataFrame, n: int = 100, method: str = "top", importance: str = "t") -> DataFrame:
    """The ``n`` results with the smallest p-value, or without one the largest importance, or without that any by id."""
    if method != "top":
        raise NotImplementedError(method)
    if "pval" in res.columns:
        return res.orderBy(F.asc_nulls_last("pval"), "probe_id").limit(n)
    return (res.orderBy(F.desc_nulls_last(importance), "probe_id") if importance in res.columns else res.orderBy("probe_id")).limit(n)


def sample_vectors(cells: DataFrame, features: list[str]) -> DataFrame:
    """``sample_id, features``: a vector of the panel's values per sample, missing ones as the feature's mean."""
    rows = cells.where(F.col("probe_id").isin(features))
    mean = rows.groupBy("probe_id").agg(F.avg("value").alias("mean"))
    full = rows.select("sample_id").distinct().crossJoin(F.broadcast(mean))  # samples by the panel's features, the result's own size
    filled = full.join(rows, ["sample_id", "probe_id"], "left").select("sample_id", "probe_id", F.coalesce("value", "mean", F.lit(0.0)).alias("v"))
    by = filled.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("probe_id", "v"))), lambda x: x["v"]).alias("a"))
    return by.select("sample_id", array_to_vector("a").alias("features"))


def infer_task(labels: DataFrame, label: str = "label") -> str:
    """Classification for text, booleans and numbers of at most ten values, else regression."""
    kind = dict(labels.dtypes)[label]
    if kind in ("string", "boolean") or labels.select(label).distinct().limit(11).count() <= 10:
        return "classification"
    return "regression"


def folds(rows: DataFrame, n: int, label: str | None, seed: int) -> DataFrame:
    """``rows`` with ``fold``; with a label, each fold has its share of every class."""
    order = F.xxhash64("sample_id", F.lit(seed))
    w = Window.partitionBy(label).orderBy(order, "sample_id") if label else Window.orderBy(order, "sample_id")
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % n)  # over samples, which are few


def _learner(task: str, method: str, seed: int, trees: int, classes: int):
    if method == "random_forest":
        kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return kind(labelCol="y", numTrees=trees, seed=seed)
    if method == "elasticnet":
        if task == "classification":
            return LogisticRegression(labelCol="y", elasticNetParam=0.5, regParam=0.01, maxIter=200)
        return LinearRegression(labelCol="y", elasticNetParam=0.5, regParam=0.1, maxIter=200)
    raise ValueError(f"unknown method {method!r}")


def _metrics(predicted: DataFrame, task: str, classes: int) -> dict[str, float]:
    if task == "regression":
        return {m: RegressionEvaluator(labelCol="y", metricName=m).evaluate(predicted) for m in ("rmse", "r2")}
    out = {"accuracy": MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(predicted)}
    if classes == 2:
        out["auc"] = BinaryClassificationEvaluator(labelCol="y").evaluate(predicted)
    return out


def model_signature(cells: DataFrame, labels: DataFrame, features: list[str], method: str = "random_forest", n_splits: int = 5, seed: int = 42,
                    task: str | None = None, trees: int = 500) -> tuple[object, dict[str, float]]:
    """A fitted model and its metrics: ``cv_*`` are means over folds it wasn't trained on, ``train_*`` are on all of its own data."""
    task = task or infer_task(labels)
    classes = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()] if task == "classification" else []
    y = F.col("label").cast("double") if task == "regression" else F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    rows = sample_vectors(cells, features).join(labels.select("sample_id", "label"), "sample_id").withColumn("y", y)
    rows = folds(rows, n_splits, "label" if task == "classification" else None, seed).cache()
    learner, total = _learner(task, method, seed, trees, len(classes)), {}
    for k in range(n_splits):
        got = _metrics(learner.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)), task, len(classes))
        for m, v in got.items():
            total[m] = total.get(m, 0.0) + v / n_splits
    model = learner.fit(rows)
    own = _metrics(model.transform(rows), task, len(classes))
    rows.unpersist()
    return model, {f"cv_{m}": v for m, v in total.items()} | {f"train_{m}": v for m, v in own.items()}


def validate_signature(train: DataFrame, train_labels: DataFrame, test: DataFrame, test_labels: DataFrame, features: list[str], method: str = "elasticnet", trees: int = 500) -> dict[str, float]:
    """Metrics on other samples of a model of the panel."""
    task = infer_task(train_labels)
    classes = [r[0] for r in train_labels.select("label").distinct().orderBy("label").collect()]
    y = F.col("label").cast("double") if task == "regression" else F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    rows = [sample_vectors(c, features).join(l.select("sample_id", "label"), "sample_id").withColumn("y", y) for c, l in ((train, train_labels), (test, test_labels))]
    model = _learner(task, method, 42, trees, len(classes)).fit(rows[0])
    return _metrics(model.transform(rows[1]), task, len(classes))
