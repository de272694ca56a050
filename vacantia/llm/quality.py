"""Quality rules per document and per host, in DataFrame functions only.

A document fails by its own words; a host is judged by the share of its documents that fail.
Shares of small hosts are drawn towards the mean of all hosts by a beta prior that is fitted to
the hosts themselves, so one bad page does not condemn a host of two.

Null text: no words (fails).  Null host: only the document's own rules count.  Repeated rows are
judged one by one.  Columns of the input that carry a name of an output column are overwritten; any other name is free.
An empty table gives an empty result; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import SPACE, WORD, stored

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(docs: DataFrame, text: str = "text", width: int = 3, min_words: int = 50,
                max_repeat_share: int = 50) -> DataFrame:
    """``docs`` with the counts of RULES and ``base_failed``, one narrow pass without a shuffle.

    Each array is a column of its own that later steps name more than once, so that it is
    computed once per row.  Repeated windows are found by sorting (hash, place) within the row.
    """
    keep = [c for c in docs.columns if c not in (*RULES, "base_failed")]
    whole = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, F.array_remove(F.split(whole, SPACE), "").alias("_w"),
                    F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    n = F.size("_w")
    d = d.select(
        *keep, "_w", n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get("_w", i + k) for k in range(width)])

    d = d.withColumn("_g", F.when(F.size("_w") >= width, F.transform(F.sequence(F.lit(0), F.size("_w") - width), window_hash)))
    d = d.withColumn("_some", F.size("_g") > F.size(F.array_distinct("_g")))
    d = d.withColumn("_s", F.when(F.col("_some"), F.sort_array(
        F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_p", F.when(F.col("_some"), F.sort_array(F.transform(
        F.filter("_s", lambda x, i: F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
                 | F.coalesce((i > 0) & (x["h"] == F.get("_s", i - 1)["h"]), F.lit(False))),
        lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("_p", i + 1) - p, F.lit(width)))),
        F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    return d.select(*keep, *RULES, failed.alias("base_failed"))


def prior(hosts: float, docs: float, failures: float, squares: float, spread: float) -> tuple[float, float | None]:
    """Mean and strength of the beta prior; no strength: the hosts do not differ beyond chance.

    ``squares`` is the sum of n * n and ``spread`` that of x * x / n over hosts of n documents and x failures.
    """
    m = failures / docs if docs else 0.0
    by_chance = hosts - 1
    room = docs - squares / docs - by_chance if docs else 0.0
    if room <= 0 or not 0 < m < 1:
        return m, None
    share = ((spread - docs * m * m) / (m * (1 - m)) - by_chance) / room
    return (m, None) if share <= 0 else (m, max(0.0, 1 / share - 1))


def host_verdicts(counted: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, ``host_failed``.

    The hosts' own table is stored first; the prior is one row, fitted over all hosts: the mean of all documents, and a
    strength from how much more the hosts' rates differ than chance makes rates of so many documents differ (moments
    of the beta-binomial, hosts weighted by their documents).  Where they differ no more than that, every host has the mean.
    """
    hosts = stored(counted.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
                   .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")))
    n, x = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    found = hosts.agg(F.count("*"), F.sum(n), F.sum(x), F.sum(n * n), F.sum(x * x / n)).first()
    m, strength = prior(*(float(v or 0) for v in found))
    if strength is None:
        return hosts.select("host", "host_docs", "host_failures", F.lit(m).alias("host_rate"), F.lit(m > max_rate).alias("host_failed"))
    shrunk = (F.col("host_failures") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("host", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry_text: bool = True, **limits) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``host_rate`` and ``kept``.

    The counted rows are stored once, since hosts and documents both need them.  The hosts join
    by equality: Spark broadcasts them below its size threshold and shuffles and splits otherwise.
    """
    max_rate = limits.pop("max_rate", 0.5)
    made = (*RULES, "base_failed", "host_rate", "kept")
    own = [c for c in docs.columns if c not in made and (carry_text or c != text)]
    # the input's columns travel in one struct, so none of them meets a name that is used on the way
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("row"), F.col(text).alias("text"), F.col(host).alias("host"))
    counted = stored(rule_counts(rows, "text", **limits).drop("text"))
    hosts = host_verdicts(counted, "host", max_rate).select(F.col("host").alias("of"), "host_rate", "host_failed")
    d = counted.join(hosts, F.col("host") == F.col("of"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return d.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)], *RULES, "base_failed", "host_rate", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", "text")
    return judge(rows, carry_text=False).filter("kept").select("row.*")
