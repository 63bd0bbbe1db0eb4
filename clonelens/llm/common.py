"""What the operators share: table access, joins that survive hot keys, order of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII blanks every word and line rule of this subpackage uses: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# A key is hot if it holds more than 1/HOT_SHARE of all rows: by pigeonhole at most HOT_SHARE are.
HOT_SHARE = 1000
# Rows without an id sort after every id.
NO_ID = (1 << 63) - 1


# Rows of a Python batch where rows carry whole texts; Spark's default of 10,000 would hold them by the 100 MB.
TEXT_BATCH = 1024
_BATCH_SETTING = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches, unless the session has a batch size of its own."""
    name, default = _BATCH_SETTING
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(TEXT_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_order(column: str) -> Column:
    """The id as a number that sorts missing ids last and joins them with each other."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no own column can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def join_hot(many: DataFrame, one: DataFrame, keys: Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``many`` with ``one``, which holds each key once and in ``count`` its rows in ``many``.

    Keys with more than 1/``HOT_SHARE`` of the ``total`` rows (at most
    ``HOT_SHARE`` keys, whatever the input) are broadcast, so their rows stay
    where they are; the others meet in a shuffled join.  ``many`` is read twice
    and should be a staged table.  ``how`` is 'inner' or 'left'.
    """
    is_hot = F.col(count) * F.lit(HOT_SHARE) > F.lit(total)
    hot = F.broadcast(one.filter(is_hot).drop(count))
    cold = one.filter(~is_hot).drop(count)
    near = many.join(hot, list(keys))
    far = many.join(hot.select(*keys), list(keys), "left_anti").join(cold, list(keys), how)
    return near.unionByName(far.select(*near.columns))
