"""T3 with the vocabulary as a table of any size: texts and terms meet by equality on runs of cells.

A text is cut into cells, the stretches between which a term may begin or end.  A run of as many cells as some
term has is looked up in the table; Spark broadcasts the table while it is below its threshold and shuffles the runs beyond it.  Of
the terms found in a text the longest claims its place first (then the first by alphabet, then by place): what overlaps is
settled within clusters of overlapping finds, which are small however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of letters, digits and + # . / that do not end in a dot; anything else is a cell of its own.
_CELL = r"[a-z0-9+#./]*[a-z0-9+#/]|(?s:.)"
_INSIDE = r"[a-z0-9+#./]"


def cells(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_CELL), 0)


def vocabulary(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms in lower case without blanks around them, and how many cells each has."""
    term = F.trim(F.lower(column))
    return terms.select(term.alias("term")).where("term <> ''").distinct().withColumn("n_cells", F.size(cells("term")))


def finds(texts: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, term): every place where a term stands whole, in cells."""
    sizes = vocab.agg(F.array_sort(F.collect_set("n_cells"))).scalar()
    d = texts.where(F.col(text).isNotNull()).select(key, cells(text).alias("_cells")).withColumn("_n", F.explode(sizes)).where(F.size("_cells") >= F.col("_n"))

    def at(i: Column) -> Column:
        return F.get("_cells", i - 1)

    def edge(c: Column, pattern: str) -> Column:
        return c.isNull() | ~c.rlike(pattern)

    runs = F.transform(F.sequence(F.lit(1), F.size("_cells") - F.col("_n") + 1), lambda i: F.struct(i.alias("start"), (i + F.col("_n") - 1).alias("end")))
    whole = F.filter(runs, lambda r: (at(r["start"]) > " ") & (at(r["end"]) > " ")
                     & edge(F.when(r["start"] > 1, at(r["start"] - 1)), _INSIDE + "$") & (edge(at(r["end"] + 1), "^" + _INSIDE) | (at(r["end"] + 1) == ".")))
    named = F.transform(whole, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.array_join(F.slice("_cells", r["start"], F.col("_n")), "").alias("term")))
    return d.select(key, F.inline(named)).join(vocab.select("term"), "term").select(key, "start", "end", "term")


def claimed(found: DataFrame, key: str) -> DataFrame:
    """(key, start, end, term): the finds that keep their place."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(reach < F.col("start"), F.lit(True)).cast("int")
    d = found.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct((-F.length("term")).alias("l"), "term", "start", "end")
    d = d.groupBy(key, "_cluster").agg(F.array_sort(F.collect_list(first)).alias("_finds"))
    none = F.array().cast("array<struct<l:int,term:string,start:int,end:int>>")
    kept = F.aggregate("_finds", none, lambda taken, x: F.when(
        F.exists(taken, lambda t: (t["start"] <= x["end"]) & (x["start"] <= t["end"])), taken).otherwise(F.concat(taken, F.array(x))))
    return d.select(key, F.inline(kept)).select(key, "start", "end", "term")


def with_terms(texts: DataFrame, vocab: DataFrame, key: str, text: str, name: str = "terms") -> DataFrame:
    """``texts`` with the distinct terms of each, in alphabetical order; ``key`` tells its rows apart."""
    found = claimed(finds(texts, vocab, key, text), key).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias(name))
    return texts.join(found, key, "left").withColumn(name, F.when(F.col(text).isNotNull(), F.coalesce(name, F.array().cast("array<string>"))))
