"""Equi-joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above rows / HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
# Groups up to this size need no splitting; hot ones are split into parts of at most this size.
SMALL_GROUP = 100_000


# A summary with at most this many (narrow) rows may be broadcast.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a per-group summary only if it proves small.

    At most ``BROADCAST_ROWS`` + 1 rows are fetched; a larger summary stays a
    distributed table and goes through an ordinary shuffled join.
    """
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shuffled_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: never planned as a broadcast.

    The optimizer guesses sizes from compressed files, which may hold far more
    than it thinks; a broadcast chosen by such a guess would pass the driver.
    """
    return left.join(right.hint("merge"), keys if isinstance(keys, str) else list(keys), how)


def _hot_limit(total: int) -> int:
    return max(total // HOT_SHARE, SMALL_GROUP)


def hot_keys(many: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """The keys of ``many`` that need splitting, and in ``__salts`` over how many salts."""
    counted = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > _hot_limit(total))
    return counted.select(*keys, F.ceil(F.col("__n") / F.lit(SMALL_GROUP)).alias("__salts"))


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: str | Sequence[str],
    spread_by: str,
    how: str = "inner",
    rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` with ``one`` on ``keys``, splitting the hot keys of ``many``.

    ``one`` holds each key once.  Rows of a hot key are spread by a hash of the
    column ``spread_by`` over as many salts as its count needs, and the hot rows
    of ``one`` (at most ``HOT_SHARE``, by pigeonhole) are repeated once per salt.
    The list of hot keys has the same proven bound, so broadcasting it is safe.
    Whoever joins ``many`` several times can give its ``hot_keys``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = many.count() if rows is None else rows
    if total <= _hot_limit(total):  # no key can be hot
        return shuffled_join(many, one, keys, how)
    hot = F.broadcast(hot_keys(many, keys, total) if hot is None else hot)
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__salts")), F.lit(0))
    left = many.join(hot, keys, "left").withColumn("__salt", salt.cast("bigint")).drop("__salts")
    last = F.coalesce(F.col("__salts"), F.lit(1)).cast("bigint") - 1
    copies = F.sequence(F.lit(0).cast("bigint"), last)
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return shuffled_join(left, right, [*keys, "__salt"], how).drop("__salt")
