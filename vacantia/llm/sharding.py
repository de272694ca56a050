"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of slots; a stored, versioned map says which shard a slot
belongs to.  Version 1 deals the slots out in turn.  Rebalancing takes the newest version, sums the bytes per slot and writes
the next one, each into a folder of its own, in which only the slots move that an overfull shard gives up.  The map has
``slots`` rows at any data size, so it may be folded in one row and broadcast.

The law is ``bytes``: sizes near equal.  It is near as the largest record or slot allows.
Null text: no bytes.  Null ids hash with their texts like any value; rows that are equal in id and text are spread over slots
where there are many.  Ties within a slot go by id, checksum and size.  Other columns are left out, whatever their names; an empty table gives
an empty result; texts may be of any length.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.common import stored
from vacantia.session import shared_dir

SLOTS = 8192


def slot_of(slots: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def first_map(spark, slots: int, shards: int) -> DataFrame:
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, given the bytes per slot.

    Each shard keeps its largest slots up to the mean size and gives up the rest; what is given
    up goes, largest first, to the shard that is emptiest by then.  Both folds run over the slot
    table, which has a fixed number of rows.
    """
    filled = current.join(sizes, "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = Window.partitionBy("version")
    within = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    # a fixed share of each shard's slots in order of size: kept while their sum stays below the mean
    ranked = (filled.withColumn("_mean", F.sum("bytes").over(total) / shards)
              .withColumn("_sum", F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("stays", (F.col("_sum") <= F.col("_mean")) | (F.col("bytes") == 0)))
    folded = ranked.groupBy("version").agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct(
            "bytes", (-F.col("vslot")).alias("v")))), False).alias("moving"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("staying"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
        F.aggregate(F.filter("staying", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]).alias("load"),
        s.alias("s")))
    folded = folded.withColumn("loads", loads)
    step = F.aggregate(
        "moving",
        F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("moved")),
        lambda acc, x: F.struct(
            F.transform(acc["loads"], lambda y: F.when(
                y["s"] == F.array_min(acc["loads"])["s"],
                F.struct((y["load"] + x["bytes"]).alias("load"), y["s"].alias("s"))).otherwise(y)).alias("loads"),
            F.concat(acc["moved"], F.array(F.struct((-x["v"]).cast("int").alias("vslot"), F.array_min(acc["loads"])["s"].alias("shard")))).alias("moved")))
    moved = folded.select(F.explode(step["moved"]).alias("m")).select(F.col("m.vslot").alias("vslot"), F.col("m.shard").alias("_to"))
    return (current.join(moved, "vslot", "left")
            .select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("_to", "shard").alias("shard")))


def store_version(version: DataFrame, path: str) -> DataFrame:
    """Write a version into a folder of its own, which must not be there yet, and give it back as stored."""
    number = version.select(F.max("version")).first()[0]
    version.drop("version").coalesce(1).write.parquet(f"{path}/version={number}")
    return newest_version(version.sparkSession, path)


def newest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The map to edit: the newest stored version; none where nothing is stored."""
    try:
        every = spark.read.schema("vslot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    number = every.select(F.max("version")).first()[0]
    return None if number is None else every.filter(F.col("version") == number).select("version", "vslot", "shard")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, text: str = "text", key: str = "doc_id",
          overhead: int = 16, map_path: str | None = None, most_equal: int = 1000) -> DataFrame:
    """One row per document: size, crc, shard, and its place ``slot`` in the shard, gapless from 0.

    ``map_path`` is where the versions of the map are kept: its newest one is edited, so that a table that has grown
    moves few slots.  Records hash by id and text; of records that are equal in both, about ``most_equal`` go to a slot.
    Places are counted in two steps, within the virtual slot and by the slots before it in the
    shard, so no task holds a whole shard.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/llm/slot-map-{uuid.uuid4().hex}"
    whole = F.coalesce(F.col(text), F.lit(""))
    record = [F.col(key).alias("id"), (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), F.xxhash64(whole).alias("h")]
    rows = docs.select(*record)
    crowds = (rows.groupBy("id", "size", "h").agg(F.count("*").alias("n")).filter(F.col("n") > most_equal)
              .select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("h").alias("_h"), F.ceil(F.col("n") / most_equal).alias("parts")))
    rows = rows.join(crowds, rows["id"].eqNullSafe(crowds["_id"]) & (rows["size"] == crowds["_size"]) & (rows["h"] == crowds["_h"]), "left")
    # which of several equal records a part gets does not matter, but both passes below have to see the same
    copy = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(0)
    rows = stored(rows.select("id", "size", "crc", F.col("id").isNull().alias("no_id"), "h", copy.alias("copy")).withColumn("vslot", slot_of(slots, "id", "no_id", "h", "copy")).drop("h", "copy", "no_id"))
    sizes = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    current = newest_version(spark, path)
    if current is None:
        current = store_version(first_map(spark, slots, shards), path)
    elif current.count() != slots:
        raise ValueError(f"the map in {path} has another number of slots")
    after = store_version(rebalance(current, sizes.select("vslot", "bytes"), shards), path)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (after.join(sizes.select("vslot", "n"), "vslot", "left")
              .withColumn("_before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)))
              .select(F.col("vslot"), "shard", "_before"))
    inside = Window.partitionBy("vslot").orderBy("id", "crc", "size")
    return (rows.withColumn("_at", F.row_number().over(inside) - 1).join(placed, "vslot")
            .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("_before") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "vslot"))
