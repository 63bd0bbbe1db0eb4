"""Exact global ranks and running totals that never pull a group into one task.

A plain ``row_number() over (order by x)`` moves all rows into one task, and
``partition by k`` moves a hot key's rows into one task.  Here the order is cut
into buckets first; bucket totals are pre-aggregated (a map-side combine), the
running sum over that small table gives each bucket its offset, and the only
wide window runs inside ``(key, bucket)``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonelens.functions.hashing import HASH_RANGE, seeded_hash
from clonelens.functions.skew import broadcast_if_small
from clonelens.session import staged


def _fan_out(df: DataFrame) -> int:
    """Square root of the bucket count: twice the shuffle partitions, 16 at least."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, math.ceil(math.sqrt(2 * partitions)))


def _ranged(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` range partitioned by ``by`` and ``order``, with the partition's number as ``__b``.

    Any bounds give the same exact ranks; Spark's sample only balances the
    partitions.  The result is staged, so that all readers see the same bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by, *order)
    return staged(ranged.withColumn("__b", F.spark_partition_id()), "ranged")


def _hash_bucket(df: DataFrame, column: str) -> Column:
    buckets = _fan_out(df) ** 2
    return F.floor(F.col(column) * F.lit(buckets) / F.lit(HASH_RANGE)).cast("int")


def _running(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str],
) -> DataFrame:
    """Running totals of rows whose ``__b`` numbers buckets along the order."""
    keyed = df
    names = list(sums)
    totals = keyed.groupBy(*by, "__b").agg(*[F.sum(sums[n]).alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in by],
        F.col("__b").alias("__ob"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names],
    )
    # without groups there is one row per bucket, so the size is bounded by the bucket count
    offsets = broadcast_if_small(offsets) if by else F.broadcast(offsets)
    match = F.col("__b") == F.col("__ob")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = (
        Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = keyed.join(offsets, match)
    for n in names:
        joined = joined.withColumn(
            n, F.col(f"__o_{n}") + F.coalesce(F.sum(sums[n]).over(inside), F.lit(0))
        )
    return joined.drop("__b").select(*[c for c in df.columns if c != "__b"], *names)


def running_totals(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add, per name in ``sums``, the total over all earlier rows (this row excluded).

    ``order`` must be unique within ``by``; pre-aggregate ties first.
    """
    return _running(_ranged(df, list(order), by), order, sums, by)


def dense_index(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``, separately for each ``by``."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by)


def hash_index(
    df: DataFrame, id_col: str, seed: str | int, by: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Number the rows in a seeded random order; ties in the hash go by id."""
    hashed = df.withColumn("__h", seeded_hash(seed, F.col(id_col)))
    bucketed = hashed.withColumn("__b", _hash_bucket(hashed, "__h"))
    out = _running(bucketed, ["__h", id_col], {name: F.lit(1).cast("bigint")}, by)
    return out.drop("__h")


def hash_quota(
    df: DataFrame,
    id_col: str,
    seed: str | int,
    fraction: float,
    by: Sequence[str],
    name: str = "chosen",
) -> DataFrame:
    """Flag the first ``ceil(fraction * n)`` rows of each ``by`` group in hash order.

    Only counts are shuffled: they tell which bucket holds the last chosen row of
    a group, that single bucket is ranked, and the rows are compared with it.
    """
    keyed = df.select(*by, id_col).withColumn("__h", seeded_hash(seed, F.col(id_col)))
    keyed = keyed.withColumn("__b", _hash_bucket(keyed, "__h"))
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    edge = broadcast_if_small(
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__quota", F.ceil(F.sum("__n").over(whole) * F.lit(float(fraction))))
        .filter((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__n") < F.col("__quota")))
        .select(
            *[F.col(c).alias(f"__k_{c}") for c in by],
            F.col("__b").alias("__eb"),
            (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__need"),
        )
    )
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    on_edge = F.col("__b") == F.col("__eb")
    for s in same:
        on_edge = on_edge & s
    rank = F.row_number().over(
        Window.partitionBy(*[f"__k_{c}" for c in by], "__eb").orderBy("__h", id_col)
    )
    cuts = broadcast_if_small(
        keyed.join(edge, on_edge)
        .withColumn("__r", rank)
        .filter(F.col("__r") == F.col("__need"))
        .select(
            *[f"__k_{c}" for c in by], F.col("__h").alias("__ch"), F.col(id_col).alias("__cid")
        )
    )
    in_group = F.lit(True)
    for s in same:
        in_group = in_group & s
    h = seeded_hash(seed, F.col(id_col))
    chosen = (h < F.col("__ch")) | ((h == F.col("__ch")) & (F.col(id_col) <= F.col("__cid")))
    return df.join(cuts, in_group, "left").select(
        *df.columns, F.coalesce(chosen, F.lit(False)).alias(name)
    )
