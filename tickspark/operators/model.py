"""Meta-labels: robust scaling, a logistic model, and conformal prediction sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection

MIN_ROWS = 800


def robust_limits(fit_on: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Median and median deviation of each feature: two numbers a feature, whatever the number of rows."""
    return {r.feature: (r.median, r.mad) for r in selection.median_deviations(fit_on, [], features).collect()}


def scaled(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Features less their median, over 1.4826 times their median deviation (1e-9 at least)."""
    return rows.withColumns({f: (F.col(f) - F.lit(middle)) / max(1e-9, 1.4826 * away) for f, (middle, away) in limits.items()})


def robust_scaled(rows: DataFrame, fit_on: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` scaled by the limits of ``fit_on``."""
    return scaled(rows, robust_limits(fit_on, features))


def conformal_threshold(calibration: DataFrame, keys: list[str] = [], alpha: float = 0.10, p: str = "p", y: str = "y") -> DataFrame:
    """The order statistic of 1 - P(true label) at the upper index of its 1 - alpha quantile."""
    score = 1.0 - F.when(F.col(y) == 1, F.col(p)).otherwise(1.0 - F.col(p))
    index = F.least(F.col("size") - 1, F.greatest(F.lit(0), F.floor((F.col("size") - 1) * (1.0 - alpha) + 0.999999)))
    found = selection.order_statistics(calibration.withColumn("__s", score), keys, "__s", [1.0 - alpha], F.array(index))
    return found.select(*keys, F.col("value").alias("threshold"), F.col("size").alias("n"))


def prediction_set(p: Column, threshold: Column) -> Column:
    return F.array_compact(F.array(F.when(p <= threshold, 0), F.when(1.0 - p <= threshold, 1)))


def with_prediction_sets(rows: DataFrame, thresholds: DataFrame, keys: list[str] = [], p: str = "p") -> DataFrame:
    """Add ``labels`` and ``abstain`` (unless exactly one label is left)."""
    joined = rows.join(thresholds.select(*keys, "threshold"), keys, "left") if keys else rows.crossJoin(F.broadcast(thresholds.select("threshold")))
    out = joined.withColumn("labels", prediction_set(F.col(p), F.col("threshold")))
    return out.withColumn("abstain", F.size("labels") != 1)


def meta_label(train: DataFrame, calibration: DataFrame, rows: DataFrame, features: list[str], label: str = "y", alpha: float = 0.10, min_rows: int = MIN_ROWS) -> DataFrame:
    """Probability, conformal set and abstention for each row, by an L2 logistic model fitted in the cluster.

    The optimum is the converged one of the penalised likelihood, not that of a fixed number of gradient steps. Fewer than ``min_rows`` labelled rows are an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = train.count() + calibration.count()
    if n < min_rows:
        raise ValueError(f"{n} labelled rows, {min_rows} needed")
    join = VectorAssembler(inputCols=features, outputCol="__x")
    limits = robust_limits(train, features)
    vectors = lambda df: join.transform(scaled(df, limits))
    fitted = LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.01, elasticNetParam=0.0, standardization=False, maxIter=100, probabilityCol="__p").fit(vectors(train))
    probability = lambda df: fitted.transform(vectors(df)).withColumn("p", vector_to_array("__p")[1]).drop("__x", "__p", "rawPrediction", "prediction")
    threshold = conformal_threshold(probability(calibration).withColumnRenamed(label, "y"), alpha=alpha)
    return with_prediction_sets(probability(rows), threshold)
