"""Analysis of result rows: rankings, summaries and the data behind each chart.

Every top-k breaks ties by ``seq`` (the training order).  Ranked windows keep a
``<= k`` filter, which Spark turns into a per-task group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonelens.functions.ranking import running_totals
from clonelens.functions.skew import broadcast_if_small
from clonelens.session import staged

# The compared measures in their order.
SCORES = ["accuracy", "balanced_accuracy", "f1_score", "roc_auc"]


def result_summary(results: DataFrame) -> DataFrame:
    """All rows, best F1 first."""
    return results.orderBy(F.desc("f1_score"), "seq")


def top_models(results: DataFrame, k: int = 5) -> DataFrame:
    top = results.orderBy(F.desc("f1_score"), "seq").limit(k)
    return top.select("model", "type", "f1_score", "accuracy", "time_ms")


def summary_by_type(results: DataFrame) -> DataFrame:
    """Mean and sample deviation per type, rounded to 4 places; one row has no deviation."""
    measures = ["accuracy", "f1_score", "time_ms"]
    columns = []
    for m in measures:
        columns.append(F.round(F.avg(m), 4).alias(f"{m}_mean"))
        columns.append(F.round(F.stddev_samp(m), 4).alias(f"{m}_std"))
    return results.groupBy("type").agg(*columns)


def _long(results: DataFrame, keep: list[str]) -> DataFrame:
    return results.unpivot(keep, SCORES, "metric", "value")


def top_per_metric(results: DataFrame, k: int = 10) -> DataFrame:
    """(metric, rank, model, type, value): the best ``k`` rows for each measure."""
    best = Window.partitionBy("metric").orderBy(F.desc("value"), "seq")
    ranked = _long(results, ["model", "type", "seq"]).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select(
        "metric", F.col("rank").cast("bigint").alias("rank"), "model", "type", "value"
    )


def fastest(results: DataFrame, k: int = 15) -> DataFrame:
    return results.orderBy("time_ms", "seq").limit(k).select("model", "type", "time_ms")


def metric_matrix(results: DataFrame, k: int = 15) -> DataFrame:
    """The four measures of the first ``k`` models in training order."""
    return results.orderBy("seq").limit(k).select("model", *SCORES)


def radar(results: DataFrame, k: int = 5) -> DataFrame:
    """(model, metric, value) of the ``k`` best models."""
    top = results.orderBy(F.desc("f1_score"), "seq").limit(k)
    return _long(top, ["model"])


def _value_counts(results: DataFrame) -> DataFrame:
    """(type, metric, value, n): equal values merged before they are ranked."""
    return (
        _long(results, ["type"]).groupBy("type", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(counts: DataFrame) -> DataFrame:
    """Linear-interpolated quartiles per (type, metric), from exact distributed ranks."""
    keys = ["type", "metric"]
    ranked = running_totals(counts, ["value"], {"below": F.col("n")}, by=keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    quarters = F.explode(F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    places = sizes.select(*keys, quarters.alias("q"), "size").withColumn(
        "at", F.col("q") * (F.col("size") - 1)
    )
    low, high = F.floor("at"), F.ceil("at")

    def covers(place):
        return (F.col("below") <= place) & (place < F.col("below") + F.col("n"))

    # at most two value rows match a place, so the join result stays tiny
    hits = ranked.join(broadcast_if_small(places), keys).filter(covers(low) | covers(high))
    bounds = hits.groupBy(*keys, "q", "at").agg(
        F.min("value").alias("v0"), F.max("value").alias("v1")
    )
    part = F.col("at") - F.floor("at")
    return bounds.select(*keys, "q", (F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("v"))


def type_boxstats(results: DataFrame) -> DataFrame:
    """Box statistics per (type, metric): quartiles, 1.5-range whiskers, number of outliers."""
    keys = ["type", "metric"]
    counts = staged(_value_counts(results), "values")
    wide = (
        _quartiles(counts)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("q") == 0.25, F.col("v"))).alias("q1"),
            F.max(F.when(F.col("q") == 0.5, F.col("v"))).alias("median"),
            F.max(F.when(F.col("q") == 0.75, F.col("v"))).alias("q3"),
        )
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counts.join(broadcast_if_small(wide), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).cast("bigint").alias("n_outliers"),
        )
    )


def type_outliers(results: DataFrame) -> DataFrame:
    """(type, metric, model, value) of the rows beyond the whiskers."""
    keys = ["type", "metric"]
    box = broadcast_if_small(type_boxstats(results).select(*keys, "whisker_low", "whisker_high"))
    rows = _long(results, ["model", "type"]).join(box, keys)
    return rows.filter(
        (F.col("value") < F.col("whisker_low")) | (F.col("value") > F.col("whisker_high"))
    ).select(*keys, "model", "value")


def types_in_order(results: DataFrame) -> DataFrame:
    """(type, first_seq): the distinct types and where each was first seen."""
    return results.groupBy("type").agg(F.min("seq").alias("first_seq"))


def feature_importance(importances: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most important of (feature, importance)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def repo_search(
    repos: DataFrame, query: str = "python cli", max_repos: int = 20, min_stars: int = 50
) -> DataFrame:
    """The most starred Python repositories whose name or description has all words of ``query``."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    wanted = (F.lower("language") == "python") & (F.col("stars") > min_stars)
    for word in query.lower().split():
        wanted = wanted & F.contains(text, F.lit(word))
    ordered = repos.filter(wanted).orderBy(F.desc("stars"), "name").limit(max_repos)
    return ordered.select("name", "clone_url", "stars")
