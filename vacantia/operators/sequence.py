"""State and ranks along a long ordered sequence without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import materialise


def carry_forward(df: DataFrame, key: str, order: str, reset: str, cols: Sequence[str],
                  chunk: int = 4096) -> DataFrame:
    """Last non-null value of each column since the last row with ``reset`` set.

    Adds ``seg`` (order value of that reset row, null when there is none), and per
    column ``cur_<c>`` (this row counted) and ``prev_<c>`` (state before this row).

    A key's rows are cut into chunks by ``order``; each chunk is summed up in one
    row, the summaries are scanned per key, and rows take their chunk's inherited
    state by a join.  So a key with a third of all rows is spread over many tasks.
    """
    d = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    pos = F.col(order)

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(pos.alias("o"), F.col(c).alias("v")))

    summary = d.groupBy(key, "_chunk").agg(
        F.max(F.when(F.col(reset), pos)).alias("_r"),
        *[F.max_by(at(c), F.when(F.col(c).isNotNull(), pos)).alias("_v_" + c) for c in cols])
    before = (Window.partitionBy(key).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    inherited = summary.select(
        key, "_chunk", F.max("_r").over(before).alias("_in_r"),
        *[F.last("_v_" + c, ignorenulls=True).over(before).alias("_in_" + c) for c in cols])
    d = d.join(inherited, [key, "_chunk"])

    def state(end: int, name: str) -> list[Column]:
        w = (Window.partitionBy(key, "_chunk").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, end))
        seg = F.max(F.when(F.col(reset), pos)).over(w)
        out = [F.coalesce(seg, F.col("_in_r")).alias("_seg_" + name)]
        for c in cols:
            local = F.last(at(c), ignorenulls=True).over(w)
            out.append(F.coalesce(local, F.col("_in_" + c)).alias(f"_{name}_{c}"))
        return out

    d = d.select("*", *state(0, "cur"), *state(-1, "prev"))
    out = [F.col(c) for c in df.columns] + [F.col("_seg_cur").alias("seg")]
    for name in ("cur", "prev"):
        for c in cols:
            v, seg = F.col(f"_{name}_{c}"), F.col("_seg_" + name)
            out.append(F.when(seg.isNull() | (v["o"] >= seg), v["v"]).alias(f"{name}_{c}"))
    return d.select(*out)


def ranked(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` of every row in its group, however large one group is.

    Rows are dealt out by ranges of (group, order) and numbered within their range; what a group has in the
    ranges before is added.  The scan over ranges has a row per group and range: as many as there are partitions
    and groups, not rows.  ``order`` should leave no ties.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialise(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()))
    counts = d.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    d = d.withColumn("_own", own)
    return (d.join(offsets, d[group].eqNullSafe(F.col("_g")) & (d["_range"] == F.col("_r")))
            .select(*df.columns, (F.col("_before") + F.col("_own")).cast("int").alias(name)))
