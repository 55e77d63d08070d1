"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed (id and text) into ``SLOTS`` virtual slots. Rows and bytes
are aggregated per slot, and a versioned table maps every slot to a shard: the
heaviest slot first, each to the shard that has least bytes so far. Records
never choose a shard themselves, so rebalancing edits the table only:
:func:`edit_map` takes slots from shards over the mean (all slots of shards that
are given up), deals them to the lightest ones and writes the next version;
every other slot stays where it is.

A slot that is heavy without one heavy record (the copies of one record under
one id, which may be a third of all rows) is dealt: its records hash once more,
with their row number, into ``SLOTS`` further slots, so no slot, window
group or task holds an unbounded share. Row numbers come from the scan
(``monotonically_increasing_id``): equal records are interchangeable, so only
which of them gets which place depends on the files' order.

A record's position in its shard is its position in its slot (a window per slot,
thousands of groups) plus the rows of the shard's earlier slots. Everything that leaves the
executors is bounded by the number of slots; the dealing itself is one SQL
aggregate over the slot table.

The law that holds is ``bytes``: sizes near equal, which is what a map made from bytes
per slot gives. No shard is above the mean by more than its heaviest record
plus one undealt slot (1/``HEAVY_PART`` of a shard).

Defined cases: a null text has no bytes (size 8, crc32 of nothing); a
null id is an id of its own; repeated rows are records of their own; very long
texts count in full; with fewer records than shards some shards stay empty; an
empty table gives no row and an empty map; columns beside the id and the text do not
matter: helper columns take names that the table does not have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name

SLOTS = 4096
HEAVY_PART = 32  # a slot above 1/32 of a shard is looked at
RECORD_BYTES = 8


@dataclass
class Names:
    """Helper columns of a table of records."""
    size: str
    slot: str
    deal: str
    row: str

    @staticmethod
    def of(columns) -> "Names":
        return Names(*[free_name(columns, n) for n in ("size", "virtual_slot", "deal_slot", "row_no")])


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               slots: int = SLOTS) -> tuple[DataFrame, Names]:
    """Adds a record's size, its virtual slot, the further slot it takes if that one is
    dealt, and its row number."""
    n = Names.of(docs.columns)
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint") + RECORD_BYTES
    out = docs.select("*", size.alias(n.size), F.monotonically_increasing_id().alias(n.row),
                      F.pmod(F.xxhash64(F.lit(1), i, t), F.lit(slots)).cast("int").alias(n.slot))
    deal = F.lit(slots) + F.pmod(F.xxhash64(F.lit(2), i, t, F.col(n.row)), F.lit(slots))
    return out.withColumn(n.deal, deal.cast("int")), n


def heavy_slots(records: DataFrame, n: Names, shards: int) -> DataFrame:
    """(slot) that holds more than 1/``HEAVY_PART`` of a shard's bytes, and not by one record."""
    per = records.groupBy(F.col(n.slot).alias("slot")).agg(F.sum(n.size).alias("bytes"),
                                                           F.max(n.size).alias("largest"))
    total = per.agg(F.sum("bytes")).scalar()
    return per.where((F.col("bytes") * F.lit(shards * HEAVY_PART) > total)
                     & (F.col("bytes") >= 2 * F.col("largest"))).select("slot")


def final_slots(records: DataFrame, n: Names, heavy: DataFrame) -> DataFrame:
    """Records under their final slot (column ``n.slot``); ``heavy`` has at most ``SLOTS`` rows."""
    flag = free_name(records.columns, "is_heavy")
    marks = F.broadcast(heavy.select(F.col("slot").alias(n.slot), F.lit(True).alias(flag)))
    return records.join(marks, n.slot, "left").withColumn(
        n.slot, F.when(F.col(flag), F.col(n.deal)).otherwise(F.col(n.slot))).drop(flag, n.deal)


def slot_weights(records: DataFrame, n: Names) -> DataFrame:
    """(slot, rows, bytes) of every used slot: at most 2 x ``SLOTS`` rows."""
    return records.groupBy(F.col(n.slot).alias("slot")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(n.size).alias("bytes"))


def deal_slots(slots: DataFrame, loads) -> DataFrame:
    """(slot, rows, bytes, shard): the heaviest slot first, each to the shard with the least
    bytes. ``loads``: array column with the bytes that every shard has already. One fold
    over the sorted slots (a bounded table)."""
    listed = slots.groupBy().agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("bytes")).alias("neg"), "slot", "rows", "bytes"))).alias("all")).select("all", loads.alias("loads"))

    def give(state, slot):
        k = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda v, i: F.when(i == k - 1, v + slot["bytes"]).otherwise(v)
                        ).alias("loads"),
            F.concat(state["shards"], F.array(k - 1)).alias("shards"))

    start = F.struct("loads", F.array().cast("array<int>").alias("shards"))
    dealt = listed.select("all", F.aggregate("all", start, give, lambda s: s["shards"]).alias("to"))
    return (dealt.select(F.inline(F.arrays_zip("all", "to")))
            .select("all.slot", "all.rows", "all.bytes", F.col("to").alias("shard")))


def first_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1: (version, slot, shard, rows, bytes)."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), shards)
    return deal_slots(weights, zero).select(F.lit(1).alias("version"), "slot", "shard", "rows", "bytes")


def edit_map(old: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for new ``weights`` or another number of shards.

    Slots that are new, lie in a shard that is given up, or are the excess of a
    shard above the mean (its lightest slots, as many as lie wholly above it) are dealt
    to the lightest shards; all others keep their shard."""
    version = old.agg(F.max("version")).scalar() + 1
    now = weights.join(old.select("slot", "shard"), "slot", "left")
    now = now.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    mean = now.agg(F.sum("bytes")).scalar() / shards
    heaviest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    full = F.sum("bytes").over(heaviest_first) - F.col("bytes") >= mean  # lies wholly above the mean
    now = now.withColumn("stays", F.col("shard").isNotNull() & ~full)
    kept = now.where("stays")
    per = kept.groupBy("shard").agg(F.sum("bytes").alias("b"))
    loads = per.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                    lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("bigint"))).alias("l"))
    moved = deal_slots(now.where("not stays").select("slot", "rows", "bytes"), loads.scalar())
    cols = ["slot", "shard", "rows", "bytes"]
    return kept.select(*cols).unionByName(moved.select(*cols)).select(version.alias("version"), *cols)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Writes one version beside the earlier ones; the same version again replaces itself."""
    (slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    stored = spark.read.schema("slot int, shard int, rows bigint, bytes bigint, version int").parquet(path)
    if version is None:
        return stored.where(F.col("version") == stored.agg(F.max("version")).scalar())
    return stored.where(F.col("version") == version)


def place(records: DataFrame, n: Names, slot_map: DataFrame, order: list) -> DataFrame:
    """Records with ``shard``, ``position`` (gapless from 0 in the shard) and ``map_version``.
    The map is bounded by the number of slots and goes to every task."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    m = slot_map.select(F.col("slot").alias(n.slot), "shard", F.col("version").alias("map_version"),
                        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_position"))
    inside = Window.partitionBy(n.slot).orderBy(*order)
    return (records.withColumn("in_slot", F.row_number().over(inside) - 1)
            .join(F.broadcast(m), n.slot)
            .withColumn("position", (F.col("first_position") + F.col("in_slot")).cast("bigint"))
            .drop("first_position", "in_slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                    slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, shard, position, map_version) of every record.
    The records' narrow columns are written once; the slot map is stored at ``map_path``
    (a table of its own by default) and read back."""
    spark = docs.sparkSession
    wide, n = with_slots(docs.select(id_col, text_col), id_col, text_col, slots)
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    records = cut_lineage(wide.withColumn("text_crc32", crc).drop(text_col))
    heavy = cut_lineage(heavy_slots(records, n, shards))
    records = final_slots(records, n, heavy)
    version1 = first_map(slot_weights(records, n), shards)
    if map_path is None:
        slot_map = cut_lineage(version1)
    else:
        save_map(version1, map_path)
        slot_map = load_map(spark, map_path, 1)
    out = place(records, n, slot_map, [id_col, "text_crc32", n.size, n.row])
    return out.select(id_col, F.col(n.size).alias("size"), "text_crc32", F.col(n.slot).alias("virtual_slot"),
                      "shard", "position", "map_version")


def write_shards(docs: DataFrame, slot_map: DataFrame, heavy: DataFrame, path: str, id_col: str = "doc_id",
                 text_col: str = "text", slots: int = SLOTS, shard_col: str = "shard") -> None:
    """Writes whole records into one folder a shard under a stored map (several files a
    shard: a slot's records are one unit of work, not a shard's)."""
    shard_col = free_name(docs.columns, shard_col)
    wide, n = with_slots(docs, id_col, text_col, slots)
    records = final_slots(wide, n, heavy)
    m = slot_map.select(F.col("slot").alias(n.slot), F.col("shard").alias(shard_col))
    (records.repartition(n.slot).join(F.broadcast(m), n.slot).drop(n.slot, n.size, n.row)
     .write.mode("error").partitionBy(shard_col).parquet(path))
