"""Line dedup by the spread of a line over sites.

A line on many sites is boilerplate.  Its spread is estimated by a HyperLogLog sketch per line
hash, kept relationally: a site hashes to a register and a rank, a sketch is the greatest rank per
(line, register), and sketches merge by that same maximum, on the map side first.  A line whose
estimate is near the threshold gets an exact distinct count of its sites.  Of each boilerplate line
the occurrence with the smallest (doc_id, place) stays; all others are removed.

Lines are compared without the white space around them; blank lines are never removed.  Null site:
counts for no site.  Null text: no lines, stays null.  Rows of one doc_id are told apart by their
text; rows equal in both are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import id_key, stored, text_key


def lines_of(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """One row per line that is not blank: row keys, place, 128 bits of hash, site."""
    d = docs.select(id_key().alias("_id"), text_key(text).alias("_key"), F.col(site).cast("string").alias("_site"),
                    F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line"))
    d = d.withColumn("_line", F.btrim("_line", F.lit(" \t\n\x0b\x0c\r"))).filter(F.col("_line") != "")
    return d.select("_id", "_key", "_site", "_at", F.xxhash64("_line").alias("_a"), F.xxhash64(F.lit(1), "_line").alias("_b"))


def register(site: str, p: int) -> tuple[Column, Column]:
    """Register and rank of a site: the low p bits, and the zeros that lead the other bits, plus one."""
    h = F.xxhash64(F.lit("site"), F.col(site))
    rest = F.shiftrightunsigned(h, p)
    rank = F.when(rest == 0, F.lit(65 - p)).otherwise(F.lit(65 - p) - F.length(F.bin(rest)))
    return h.bitwiseAND(F.lit((1 << p) - 1)).cast("int"), rank.cast("int")


def estimated(sketches: DataFrame, p: int) -> DataFrame:
    """Estimate of each sketch, with linear counting while registers are empty."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    each = sketches.groupBy("_a", "_b").agg(F.count("_reg").alias("_used"), F.sum(F.pow(F.lit(2.0), -F.col("_rank"))).alias("_sum"),
                                            F.min("_first").alias("_first"))
    raw = alpha * m * m / (F.coalesce("_sum", F.lit(0.0)) + (m - F.col("_used")))
    return each.withColumn("spread", F.when((raw <= 2.5 * m) & (F.col("_used") < m), m * F.log(m / (m - F.col("_used")))).otherwise(raw))


def boilerplate(lines: DataFrame, min_sites: int = 10, p: int = 10) -> DataFrame:
    """Lines on at least ``min_sites`` sites, each with its first occurrence.

    From half of the threshold (sites can share registers) to ``4 * 1.04 / sqrt(2**p)`` above it (at least one site) the exact count decides.
    """
    reg, rank = register("_site", p)
    first = F.struct("_id", "_at", "_key")
    sketches = (lines.withColumn("_reg", F.when(F.col("_site").isNotNull(), reg)).withColumn("_r", rank)
                .groupBy("_a", "_b", "_reg").agg(F.max("_r").alias("_rank"), F.min(first).alias("_first")))
    sketches = sketches.withColumn("_rank", F.when(F.col("_reg").isNotNull(), F.col("_rank")))
    band = max(1.0, min_sites * 4 * 1.04 / 2 ** (p / 2))
    known = stored(estimated(sketches, p).filter(F.col("spread") >= min(min_sites - band, min_sites / 2)).select("_a", "_b", "_first", "spread"))
    sure = known.filter(F.col("spread") > min_sites + band)
    near = known.filter(F.col("spread") <= min_sites + band)
    exact = (lines.join(near.select("_a", "_b"), ["_a", "_b"], "left_semi").groupBy("_a", "_b")
             .agg(F.countDistinct("_site").alias("_n")).filter(F.col("_n") >= min_sites).select("_a", "_b"))
    return sure.select("_a", "_b", "_first").unionByName(near.join(exact, ["_a", "_b"]).select("_a", "_b", "_first"))


def marked(docs: DataFrame, text: str, site: str, min_sites: int, p: int) -> DataFrame:
    """``row`` (the document) and ``_gone``: the places of its lines that go, or null."""
    lines = stored(lines_of(docs, text, site))
    common = boilerplate(lines, min_sites, p)
    gone = (lines.join(common, ["_a", "_b"])
            .filter((F.col("_id") != F.col("_first._id")) | (F.col("_at") != F.col("_first._at")) | (F.col("_key") != F.col("_first._key")))
            .groupBy("_id", "_key").agg(F.sort_array(F.collect_set("_at")).alias("_gone")))
    d = docs.select(F.struct(*docs.columns).alias("row"), id_key().alias("_i"), text_key(text).alias("_k"))
    return d.join(gone, (d["_i"] == gone["_id"]) & (d["_k"] == gone["_key"]), "left").select("row", "_gone")


def left_over(text: str) -> Column:
    """The text without its lines in ``_gone``."""
    split = F.split(F.col(f"row.{text}"), "\n")
    kept = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    return F.when(F.col("_gone").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n"))


def strip_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, p: int = 10) -> DataFrame:
    """``docs`` with the text that stays, columns as they were."""
    d = marked(docs, text, site, min_sites, p)
    return d.select(*[left_over(text).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, p: int = 10) -> DataFrame:
    """``docs`` with the text that stays, ``n_lines`` (not blank) and ``n_removed``; columns of these names give way."""
    d = marked(docs, text, site, min_sites, p)
    counted = F.size(F.filter(F.split(F.coalesce(F.col(f"row.{text}"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    return d.select(*[left_over(text).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
                    counted.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
