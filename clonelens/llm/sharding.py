"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into thousands of slots once and for all.  Only the bytes
and rows of each slot are aggregated; the slots are dealt to shards, largest
first to the lightest shard, and that map is a small stored table.  Adding
shards edits the map (a new version that moves as few slots as needed), it never
changes a record's slot.  Everything is DataFrame expressions; the map has
exactly ``slots`` rows, which bounds what is gathered and broadcast.

Defined cases: a missing text counts as empty (8 bytes, CRC 0); rows without
an id are hashed by their text; repeated rows share a slot, unless their id (or
text, without an id) holds more than 1/``HOT_SHARE`` of all rows: those are spread over all
slots by their place in the table, anew whenever the table is dealt; an empty table
gives no rows and a map that deals the empty slots in turn.  Other columns of the
input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonelens.llm.common import HOT_SHARE, packed_row, table
from clonelens.session import staged

SLOTS = 4096
SHARDS = 24
RECORD_OVERHEAD = 8


def _key() -> Column:
    by_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return F.when(F.col("doc_id").isNull(), by_text).otherwise(F.xxhash64(F.col("doc_id").cast("bigint")))


def with_slot(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``virtual_slot`` instead of their ``__key`` and ``__nth``.

    Rows of one key share a slot; a hot key (at most ``HOT_SHARE`` keys, so the
    list can be broadcast) is spread by ``__nth``.  ``rows`` is read three times.
    """
    counts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter((F.col("n") > 1) & (F.col("n") * F.lit(HOT_SHARE) > F.lit(rows.count())))
    marked = rows.join(F.broadcast(hot.select("__key", F.lit(True).alias("__hot"))), "__key", "left")
    at = F.when(F.col("__hot"), F.xxhash64("__key", "__nth")).otherwise(F.col("__key"))
    return marked.withColumn("virtual_slot", F.pmod(at, F.lit(slots)).cast("int")).drop("__key", "__nth", "__hot")


def record_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + RECORD_OVERHEAD


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): the text itself is not kept."""
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        record_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("text_crc32"),
        _key().alias("__key"),
        F.monotonically_increasing_id().alias("__nth"),
    )
    return with_slot(staged(slim, "shard-keys"), slots)


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, n_rows, n_bytes) for all ``slots`` slots, empty ones too."""
    found = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").select(
        "virtual_slot",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def _added(loads: Column, shard: Column, amount: Column) -> Column:
    return F.transform(
        loads,
        lambda x: F.when(x["shard"] == shard, F.struct((x["load"] + amount).alias("load"), x["shard"].alias("shard"))).otherwise(x),
    )


def first_map(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(version 1, virtual_slot, shard): slots by falling size, each to the lightest shard."""
    ordered = totals.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("less"), "virtual_slot"))).alias("slots")
    )
    empty = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.struct(F.lit(0).cast("bigint").alias("load"), i.cast("int").alias("shard")),
    )
    # an empty slot weighs one byte here, so that empty slots are dealt in turn as well
    weight = lambda x: F.greatest(-x["less"], F.lit(1).cast("bigint"))
    dealt = F.aggregate(
        "slots",
        F.struct(empty.alias("loads"), F.array().cast("array<int>").alias("at")),
        lambda a, x: F.struct(
            _added(a["loads"], F.array_min(a["loads"])["shard"], weight(x)).alias("loads"),
            F.concat(a["at"], F.array(F.array_min(a["loads"])["shard"])).alias("at"),
        ),
    )
    placed = ordered.select(F.explode(F.arrays_zip("slots", dealt["at"].alias("shard"))).alias("p"))
    return placed.select(
        F.lit(1).alias("version"), F.col("p.slots.virtual_slot").alias("virtual_slot"), F.col("p.shard").alias("shard")
    )


def rebalanced_map(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards, at least as many as before.

    Slots are tried by falling size; one leaves its shard only if that shard is
    above the mean and the lightest shard stays at or below it with the slot, so
    few slots move.  All others keep their shard.
    """
    sized = old.join(totals, "virtual_slot")
    state = sized.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"),
        F.max("version").alias("version"),
        F.sum("n_bytes").alias("total"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.struct(
            F.aggregate(
                F.filter(F.col("slots"), lambda s: s["shard"] == i), F.lit(0).cast("bigint"), lambda a, s: a - s["less"]
            ).alias("load"),
            i.cast("int").alias("shard"),
        ),
    )
    state = state.withColumn("loads", loads).withColumn("mean", F.col("total") / F.lit(shards))

    def step(a: Column, x: Column) -> Column:
        lightest = F.array_min(a["loads"])
        own = F.element_at(a["loads"], x["shard"] + 1)
        leaves = (x["less"] < 0) & (own["load"] > F.col("mean")) & (lightest["load"] - x["less"] <= F.col("mean"))
        to = F.when(leaves, lightest["shard"]).otherwise(x["shard"])
        after = F.when(leaves, _added(_added(a["loads"], x["shard"], x["less"]), lightest["shard"], -x["less"])).otherwise(
            a["loads"]
        )
        return F.struct(after.alias("loads"), F.concat(a["at"], F.array(to)).alias("at"))

    dealt = F.aggregate("slots", F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("at")), step)
    placed = state.select("version", F.explode(F.arrays_zip("slots", dealt["at"].alias("to"))).alias("p"))
    return placed.select(
        (F.col("version") + 1).alias("version"), F.col("p.slots.virtual_slot").alias("virtual_slot"), F.col("p.to").alias("shard")
    )


def place(rows: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with their shard and ``slot``, the row's gapless number inside the shard.

    The rows before a virtual slot come from the totals; rows are numbered only
    inside their virtual slot, never inside a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(totals, "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(F.broadcast(starts), "virtual_slot")  # one row per virtual slot
        .withColumn("slot", (F.col("__start") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("__start")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, stored map): see ``records`` and ``place``."""
    rows = staged(records(docs, slots), "shard-records")
    totals = staged(slot_totals(rows, slots), "shard-totals")
    slot_map = staged(first_map(totals, shards), "shard-map")
    return place(rows, totals, slot_map), slot_map


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write the whole documents as Parquet, one folder ``shard=N`` per shard."""
    rows = with_slot(docs.select(packed_row(docs), _key().alias("__key"), F.monotonically_increasing_id().alias("__nth")), slots)
    where = slot_map.select("virtual_slot", F.col("shard").alias("__shard"))
    placed = rows.join(F.broadcast(where), "virtual_slot").repartition("virtual_slot")
    placed.select("__row.*", F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a map's version to the maps stored under ``path``; a stored version cannot be written again."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("virtual_slot", "shard").write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, virtual_slot, shard): a stored map by its number, the latest if none is given."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    number = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == F.lit(number)).select("version", "virtual_slot", "shard")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed, _ = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
