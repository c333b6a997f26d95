"""Sharding by fixed virtual slots.

Every record is hashed into one of thousands of virtual slots; bytes are summed
per slot (a fixed number of rows, whatever the input), and a versioned map sends
slots to shards.  Rebalancing edits the map, never the hash, so only the rows of
moved slots change shard.

The law held is ``bytes``: shard sizes are as near equal as the slots allow.

Defined results: a NULL text has size 1 and CRC 0; rows with a NULL or repeated
id are hashed with their text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import stored

SLOTS = 4096


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (NULL: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """Virtual slot of a record; depends on the record alone."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, rows for every one of the ``slots`` slots (empty ones too); input: vslot, size."""
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _least_loaded(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - F.lit(1)).cast("int")


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot map: largest slot first, each to the least loaded shard.

    The fold runs over one array of ``slots`` entries, a constant.
    Columns: version, vslot, shard.
    """
    order = F.reverse(F.sort_array(F.collect_list(F.struct("bytes", "vslot"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
                     F.array().cast("array<struct<vslot:int,shard:int>>").alias("map"))

    def step(acc: Column, x: Column) -> Column:
        shard = _least_loaded(acc["loads"])
        return F.struct(F.transform(acc["loads"], lambda v, i: F.when(i == shard, v + x["bytes"]).otherwise(v)).alias("loads"),
                        F.concat(acc["map"], F.array(F.struct(x["vslot"].alias("vslot"), shard.alias("shard")))).alias("map"))

    folded = loads.agg(F.aggregate(order, start, step)["map"].alias("map"))
    return folded.select(F.lit(1).alias("version"), F.explode("map").alias("m")).select("version", "m.vslot", "m.shard")


def grow_map(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """Next version of the map for one more shard: every old shard gives slots, in a
    fixed random order, until it is down to the new fair share; other slots stay."""
    last = slot_map.where(F.col("version") == slot_map.agg(F.max("version").alias("v")).first()["v"])
    joined = last.join(loads, "vslot")
    whole = Window.partitionBy()
    per_shard = Window.partitionBy("shard")
    fair = F.sum("bytes").over(whole) / F.lit(float(shards + 1))
    given = F.sum("bytes").over(per_shard.orderBy(F.xxhash64("vslot", F.lit("grow")), "vslot"))
    excess = F.sum("bytes").over(per_shard) - fair
    moved = (given <= excess) & (F.col("bytes") > 0)
    return joined.select((F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def number_rows(records: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``: the row's place in its shard, gapless from 0.

    Places are counted from the slots' row counts (prefix sums over a constant
    number of rows) plus the rank inside the virtual slot, so no shard is ever
    gathered in one task.  A hot slot is split by a hash of the record first.
    """
    fine = records.withColumn("part", F.pmod(F.xxhash64("order_key"), F.lit(64)))
    parts = fine.groupBy("vslot", "part").agg(F.count("*").alias("part_rows"))
    offsets = (parts.join(F.broadcast(slot_map), "vslot")
               .withColumn("base", F.sum("part_rows").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)))
               .select("vslot", "part", "shard", F.coalesce("base", F.lit(0)).alias("base")))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("order_key"))
    return (fine.withColumn("rank", rank).join(offsets, ["vslot", "part"])
            .withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")).drop("part", "base", "rank"))


def assign_shards(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot for every row of ``docs``."""
    records = stored(docs.select(
        F.col(id_col).alias("doc_id"), byte_size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        slot_of(id_col, text_col, slots).alias("vslot"), F.xxhash64(text_col, id_col).alias("order_key")), "shard-records")
    loads = stored(slot_loads(records, slots), "slot-loads")
    slot_map = stored(first_map(loads, shards), "slot-map")
    return number_rows(records, slot_map, loads).drop("order_key")


def with_shards(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``; only sizes are summed, no text is shuffled."""
    sizes = docs.select(slot_of(id_col, text_col, slots).alias("vslot"), byte_size(text_col).alias("size"))
    slot_map = stored(first_map(stored(slot_loads(sizes, slots), "slot-loads"), shards), "slot-map")
    placed = slot_map.select(F.col("vslot").alias("virtual_slot"), "shard")
    return docs.withColumn("virtual_slot", slot_of(id_col, text_col, slots)).join(F.broadcast(placed), "virtual_slot").select(*docs.columns, "virtual_slot", "shard")
