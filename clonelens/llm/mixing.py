"""Mixing sources to target weights by systematic sampling.

A document of a source is expected ``target / size`` times.  The expected
copies are summed up along the source's documents, one seeded random offset per
source is added, and a document is emitted once per integer boundary its stretch
crosses.  Whole documents are taken, so the words miss the target by up to the
longest document.  Two things keep that small: one hashed half of the documents
stands by rising, the other by falling size, so that the rounding of long
documents cancels out; and of ``OFFSETS`` evenly spaced offsets from the random
one, a source uses the one whose words come nearest to its target.

Order and ranks are global but nobody sorts a whole source: the documents are
range partitioned by source and that order, numbered inside their partition, and
the rows before a partition come from one summary row per partition and source.

Defined cases: a missing text has size 0; a missing source is a source of its own
that sorts last; repeated rows (same id, text and source) are documents of their own
that stand next to each other, so each row is expected as often as any other; which of
them carries a copy more is open, and if they differ in other columns the first found does; sources without words get target 0 and no copies; an
empty table gives no rows.  Columns of the input pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonelens.functions.hashing import HASH_RANGE, seeded_hash
from clonelens.functions.skew import broadcast_if_small
from clonelens.llm.common import WORD, id_order, packed_row, table, whole_text
from clonelens.session import staged

SEED = "mix"
MAX_COPIES = 3
OFFSETS = 32  # tried per source
WEIGHTS = 3  # sources weigh 1, 2, 3, 1, 2, 3, ... in code point order
_EXACT = "decimal(38,0)"


def _size() -> Column:
    return F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    All targets add up to all sizes.  They are in proportion to the weights up to
    ``MAX_COPIES`` times a source's size; what is cut off goes to the other
    sources by weight.  Sources by falling need of a cut are capped as long as
    the common level is above their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a summary: one row per source
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % WEIGHTS + 1).cast("bigint"))
    cap = F.lit(MAX_COPIES) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") * (F.lit(6) / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighed.select(
        "*", left.alias("left"), weights.alias("weights"), F.row_number().over(order).alias("place")
    )
    below = F.col("left").cast(_EXACT) * F.col("weight") <= cap.cast(_EXACT) * F.col("weights")
    level = F.min(F.when(below, F.struct("place", "left", "weights"))).over(everything)
    share = (F.col("weight") * level["left"]).cast("double") / level["weights"].cast("double")
    target = F.when(F.col("place") < level["place"], cap.cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, __d, __t, source, size, source_size, target, copies), one row per document."""
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), id_order("doc_id").alias("__d"),
        F.xxhash64(whole_text()).alias("__t"), F.col("source").cast("string").alias("source"), _size().alias("size"),
    )
    units = staged(slim.withColumn("__tie", F.monotonically_increasing_id()), "mix-units")
    falls = F.pmod(seeded_hash(seed, F.col("__d")), F.lit(2))
    slope = F.when(falls == 0, F.col("size")).otherwise(-F.col("size"))
    order = [F.col("source").asc_nulls_last(), falls, slope, F.col("__d"), F.col("__t"), F.col("__tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = units.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id holds the partition in its upper bits and the row's place in the lower 33
    numbered = staged(ranged.withColumn("__at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("__at", 33).alias("__part")
    blocks = numbered.groupBy(part, "source").agg(
        F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")
    )
    blocks = staged(blocks, "mix-blocks")
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = starts.withColumnRenamed("source", "__s").join(
        staged(source_targets(sizes), "mix-targets"), F.col("__s").eqNullSafe(F.col("source"))
    )
    starts = starts.select("__part", "__s", "first", "before", "source_size", "target")
    same = (part == F.col("__part")) & F.col("source").eqNullSafe(F.col("__s"))
    found = numbered.join(broadcast_if_small(starts), same)
    rank = F.col("before") + F.col("__at") - F.col("first")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def taken(j: Column) -> Column:
        offset = seeded_hash(seed, F.coalesce(F.col("source"), F.lit(""))) / F.lit(float(HASH_RANGE)) + j / F.lit(float(OFFSETS))
        crossed = F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)
        return F.least(crossed, F.lit(MAX_COPIES)).cast("bigint")

    tried = found.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))))
    sums = tried.groupBy("source", "j").agg(
        F.sum(taken(F.col("j")) * F.col("size")).alias("words"), F.max("target").alias("target")
    )
    nearest = F.min(F.struct(F.abs(F.col("words") - F.col("target")), F.col("j"))).getField("j")
    chosen = staged(sums.groupBy("source").agg(nearest.alias("j")).withColumnRenamed("source", "__o"), "mix-offsets")
    placed = found.join(broadcast_if_small(chosen), F.col("source").eqNullSafe(F.col("__o")))
    return placed.select("doc_id", "__d", "__t", "source", "size", "source_size", "target", taken(F.col("j")).alias("copies"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents' rows, each as often as the mix takes it."""
    plan = copies(docs, seed).groupBy("__d", "__t", F.col("source").alias("__s"))
    plan = plan.agg(F.sum("copies").alias("taken"), F.count(F.lit(1)).alias("n"))
    # repeated rows get the whole part of their share each, one of them the copies left over
    shares = [F.floor(F.col("taken") / F.col("n")).cast("bigint").alias("each"), (F.col("taken") % F.col("n")).alias("over")]
    plan = staged(plan.filter("taken > 0").select("__d", "__t", "__s", *shares), "mix-plan")
    rows = docs.select(
        packed_row(docs), id_order("doc_id").alias("__id"), F.xxhash64(whole_text()).alias("__text"),
        F.col("source").cast("string").alias("__source"),
    )
    same = (F.col("__id") == F.col("__d")) & (F.col("__text") == F.col("__t")) & F.col("__source").eqNullSafe(F.col("__s"))
    met = rows.join(plan, same)
    several = lambda c: F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))
    over = met.filter("over > 0").dropDuplicates(["__d", "__t", "__s"])
    out = met.filter("each > 0").select("__row", several("each")).unionByName(over.select("__row", several("over")))
    return out.select("__row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of all documents with source weights 1, 2, 3, ... takes of each."""
    plan = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER o AS place,
    sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM named WINDOW o AS (ORDER BY source_size * (6 / weight), source NULLS LAST)
), level AS (
  SELECT place AS cut, rest AS level_rest, weights AS level_weights FROM ranked
  WHERE rest * weight <= {MAX_COPIES} * source_size * weights ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN place < cut THEN ({MAX_COPIES} * source_size)::DOUBLE
         ELSE (weight * level_rest)::DOUBLE / level_weights::DOUBLE END AS target
  FROM ranked, level
), keyed AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 2 AS falls FROM sized
), stretched AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    ('0x' || substr(md5('{SEED}:' || coalesce(s.source, '')), 1, 8))::BIGINT / {float(HASH_RANGE)} AS shift,
    row_number() OVER (
      PARTITION BY s.source ORDER BY falls, CASE WHEN falls = 0 THEN s.size ELSE -s.size END, s.doc_id) - 1 AS rank, s.source
  FROM keyed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, least(floor((rank + 1) * each + (shift + j / {float(OFFSETS)})) - floor(rank * each + (shift + j / {float(OFFSETS)})),
    {MAX_COPIES})::BIGINT AS copies
  FROM stretched, (SELECT unnest(range({OFFSETS})) AS j)
), tried AS (
  SELECT source, j, abs(sum(copies * size) - max(target)) AS away FROM counted GROUP BY source, j
), chosen AS (
  SELECT source, j FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY away, j) = 1
)
SELECT c.doc_id, c.size, c.source_size, c.target, c.copies * c.size AS taken, c.copies
FROM counted c JOIN chosen o ON c.j = o.j AND c.source IS NOT DISTINCT FROM o.source
"""
