"""Scores of (label, prediction[, score]) rows, one-row results and curve tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.ranking import dense_index, running_totals
from clonelens.session import staged


def _share(hits: Column, total: Column) -> Column:
    """hits / total as double, 0 over an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        hits.cast("double") / F.when(total == 0, F.lit(1)).otherwise(total).cast("double")
    )


def _cells() -> dict[str, Column]:
    label, prediction = F.col("label"), F.col("prediction")
    return {
        "tp": F.count_if((label == 1) & (prediction == 1)),
        "fn": F.count_if((label == 1) & (prediction != 1)),
        "fp": F.count_if((label != 1) & (prediction == 1)),
        "tn": F.count_if((label != 1) & (prediction != 1)),
    }


def class_scores(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, balanced_accuracy, f1_score) in one pre-aggregated pass.

    Balanced accuracy is the mean recall of the classes present; F1 takes class
    1 as positive and is 0 when nothing is or should be positive.
    """
    by = by or []
    counted = scored.groupBy(*by).agg(*[c.alias(n) for n, c in _cells().items()])
    tp, fn, fp, tn = (F.col(n) for n in ("tp", "fn", "fp", "tn"))
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    recalls = _share(tp, tp + fn) + _share(tn, tn + fp)
    return counted.select(
        *by,
        (tp + fn + fp + tn).alias("n"),
        _share(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        _share(recalls, present).alias("balanced_accuracy"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def accuracy(scored: DataFrame) -> DataFrame:
    return class_scores(scored).select("accuracy")


def balanced_accuracy(scored: DataFrame) -> DataFrame:
    return class_scores(scored).select("balanced_accuracy")


def f1_score(scored: DataFrame) -> DataFrame:
    return class_scores(scored).select("f1_score")


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """(label, prediction, n): all four cells, zeros included."""
    counted = scored.agg(*[c.alias(n) for n, c in _cells().items()])
    cells = F.array(
        *[
            F.struct(
                F.lit(label).cast("bigint").alias("label"),
                F.lit(prediction).cast("bigint").alias("prediction"),
                F.col(n).alias("n"),
            )
            for n, label, prediction in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )
    return counted.select(F.inline(cells))


def _by_score(scored: DataFrame, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties are merged before anything is ranked."""
    return (
        scored.select(F.col(score).cast("double").alias("score"), "label")
        .groupBy("score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    )


def roc_auc(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row ``roc_auc``: the rank statistic with shared ranks for ties.

    0 where it is undefined: a single class, or a missing score.
    """
    tied = _by_score(scored, score)
    below = running_totals(tied, ["score"], {"neg_below": F.col("neg")})
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    total = below.agg(
        F.sum(wins).alias("wins"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("unscored"),
    )
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    defined = (pairs > 0) & (F.col("unscored") == 0)
    return total.select(
        F.when(defined, F.col("wins") / F.when(pairs > 0, pairs)).otherwise(F.lit(0.0)).alias("roc_auc")
    )


def roc_points(scored: DataFrame, score: str = "score", drop_intermediate: bool = True) -> DataFrame:
    """(point, threshold, fpr, tpr) from the highest score down, after the origin (0, 0).

    ``drop_intermediate`` leaves out a threshold whose step repeats the next one
    in both counts (such points lie on a straight line); the ends stay.
    """
    tied = staged(_by_score(scored, score).withColumn("down", -F.col("score")), "ties")
    before = {"fp": F.col("neg"), "tp": F.col("pos"), "at": F.lit(1).cast("bigint")}
    steps = staged(running_totals(tied, ["down"], before), "steps")
    totals = tied.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if drop_intermediate:
        following = steps.select((F.col("at") - 1).alias("at"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2"))
        same = (F.col("pos") == F.col("pos2")) & (F.col("neg") == F.col("neg2"))
        steps = steps.join(following, "at", "left").filter(
            (F.col("at") == 0) | F.col("pos2").isNull() | ~same
        )
    kept = steps.select(
        F.col("score").alias("threshold"),
        _share(F.col("fp") + F.col("neg"), F.lit(totals["n"])).alias("fpr"),
        _share(F.col("tp") + F.col("pos"), F.lit(totals["p"])).alias("tpr"),
        "at",
    )
    numbered = dense_index(kept, ["at"], name="point").select(
        (F.col("point") + 1).alias("point"), "threshold", "fpr", "tpr"
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("point"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(numbered)


def trapezoid_area(points: DataFrame, order: str = "point", x: str = "fpr", y: str = "tpr") -> DataFrame:
    """One row ``area`` under points numbered without gaps: neighbours meet in an equi-join."""
    here = points.select(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    before = here.select((F.col("o") + 1).alias("o"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    strip = (F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / F.lit(2.0)
    return here.join(before, "o").agg(F.coalesce(F.sum(strip), F.lit(0.0)).alias("area"))


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """(model, mean_f1, spread_f1): mean and twice the population deviation over folds."""
    return fold_scores.groupBy("model").agg(
        F.avg("cv_f1").alias("mean_f1"), (F.lit(2.0) * F.stddev_pop("cv_f1")).alias("spread_f1")
    )


def learning_curve_summary(fold_scores: DataFrame) -> DataFrame:
    """(model, size, mean and population deviation of the train and the held-out F1)."""
    return fold_scores.groupBy("model", "size").agg(
        F.avg("train_f1").alias("train_mean"),
        F.stddev_pop("train_f1").alias("train_std"),
        F.avg("cv_f1").alias("cv_mean"),
        F.stddev_pop("cv_f1").alias("cv_std"),
    )


def all_scores(scored: DataFrame, score: str = "score") -> dict[str, float]:
    """The four scores of one model as numbers, for a result row."""
    row = class_scores(scored).first()
    auc = roc_auc(scored, score).first()["roc_auc"]
    return {
        "accuracy": row["accuracy"],
        "balanced_accuracy": row["balanced_accuracy"],
        "roc_auc": auc,
        "f1_score": row["f1_score"],
    }
