"""N-gram Jaccard join: documents whose sets of word shingles are alike, as connected components.

Two sets x and y link when 100 * |x & y| >= 85 * |x | y|, that is, when they share at least
a(x, y) = 85 * (|x| + |y|) / 185 shingles.  In any one order of all shingles they then share one among the
first |x| - a + 1 of x and the first |y| - a + 1 of y.  Three such orders are in use: by the number of sets
that have a shingle, and two random ones among those that more than one set has (what one set alone has
comes first in all of them).  A pair is verified only if it passes under every order.

1. Every shingle's hash is sent once per slice of the input to the bucket of its hash; there the distinct
   sets that have it are counted, and what several sets share goes back to the set, now collected by the set's
   fingerprint.  What a single set has goes nowhere.  A set of which more than 15 % is its own links with nothing.
2. In each list of sets that meet at a shingle under the first order, one pivot (the set with the least that is
   rare) is compared with all; linked sets become one class.  A group of near copies is one class after this.  A
   second round takes its pivots from outside of the first one's class.
3. What may still be linked is every pair of different classes in a list; it is met by equality on the
   shingle, and the list of sets outside of the list's main class is kept apart, so members of one class do not meet again.
   A pair's bound (the first shingle that both have stands early enough in both) is part of the join.

So no pair within a class is made, and none is lost between classes: after the last step every pair of different
classes that passes the filters has been verified.  Sets that are equal are one set with several documents.

Shingles are 64-bit hashes (56 of them and the bucket while they travel); documents are told apart by their set,
by 128 bits.  Null text or no words: an empty set, linked with nothing.  Rows of a null or repeated doc_id are rows of their
own; the smallest id of a component is taken over ids that are not null, so it is null where all are.  Ties do not matter: a
component is the same whichever pivot is taken.  An empty table gives an empty result.  A text of any length is read
whole; it is worked off alone where it is longer than a slice.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import chunks, mix, partitions, rolling, starts_of, stored, word_hashes
from vacantia.llm.neardup import classes
from vacantia.llm.substring import squeeze, unsqueeze

SHINGLE, WHOLE, FIRST, SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3
ORDERS = (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)
LOW = (1 << 56) - 1
SENT = "bucket int, f1 binary, f2 binary, sizes binary, counts binary, low binary"
SHARED = "part int, f1 binary, f2 binary, sizes binary, counts binary, shingles binary, having binary"
SETS = "f1 bigint, f2 bigint, n int, alone int, rare double, shingles array<bigint>, second array<bigint>, third array<bigint>"
DOCS = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint"
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}


def record(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, ARROW[k]) for x, k in zip(columns, kinds, strict=True)], names=list(names))


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, byte by byte; null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    data = np.frombuffer(data, np.uint8)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(data + upper * np.uint8(32)), offset=texts.offset)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text by text; how many each has; two fingerprints per text."""
    words, counts = word_hashes(lowered(texts))
    starts = starts_of(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    h, at = rolling(words, width, SHINGLE), np.empty(0, np.int64)
    if len(h):
        whole = np.flatnonzero(row[:len(h)] == row[width - 1:])
        h, at = h[whole], row[whole]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = [sum(int(words[starts[k] + i]) * pow(WHOLE, i + 1, 2**64) for i in range(counts[k])) + int(counts[k]) for k in few]
        h, at = np.concatenate([h, mix(np.array([x % 2**64 for x in short], np.uint64))]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[keep], at[keep]
    n = np.bincount(at, minlength=len(counts))
    f1, f2 = np.zeros((2, len(counts)), np.uint64)
    if len(h):
        lead = np.flatnonzero(n)
        begin = starts_of(n)[lead]
        f1[lead] = np.add.reduceat(mix(h ^ np.uint64(FIRST)), begin)
        f2[lead] = np.add.reduceat(mix(h ^ np.uint64(SECOND)), begin)
    return h, n, f1.view(np.int64), f2.view(np.int64)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and the fingerprints of its set, null for an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            _, n, f1, f2 = shingle_sets(batch["text"], width)
            yield record(DOCS, [batch["doc_id"].cast(pa.int64()), n, pa.array(f1, mask=n == 0), pa.array(f2, mask=n == 0)])

    return docs.select("doc_id", "text").mapInArrow(run, DOCS)


def ranges(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... counts[0] places, then those of the next."""
    return np.repeat(begin - starts_of(counts), counts) + np.arange(int(counts.sum()))


def send(docs: DataFrame, width: int, buckets: int, slice_bytes: int) -> DataFrame:
    """Per slice and bucket: the shingles of each distinct set of the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", slice_bytes):
            h, n, f1, f2 = shingle_sets(batch["text"], width)
            if not len(h):
                continue
            _, first = np.unique(np.stack([f1, f2, n]), axis=1, return_index=True)
            first = np.sort(first[n[first] > 0])
            h = h[ranges(n[first], starts_of(n)[first])]
            own = np.repeat(np.arange(len(first)), n[first])
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket * len(first) + own, kind="stable")
            h, own, bucket = h[order], own[order], bucket[order]
            low = h.view(np.uint8).reshape(-1, 8)[:, :7]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                lead = np.flatnonzero(np.diff(own[a:b], prepend=-1))
                sets = first[own[a:b][lead]]
                rows.append((int(bucket[a]), f1[sets].tobytes(), f2[sets].tobytes(), squeeze(n[sets]), squeeze(np.diff(lead, append=b - a)), low[a:b].tobytes()))
            for at in range(0, len(rows), 64):
                yield record(SENT, [list(c) for c in zip(*rows[at:at + 64], strict=True)])

    return docs.select("text").mapInArrow(run, SENT)


def joined(group: pa.Table, *names: str) -> list[np.ndarray]:
    """The packed columns of all rows, one after the other."""
    out = []
    for c in names:
        packed = group[c].to_pylist()
        out.append(np.concatenate([unsqueeze(x) for x in packed]) if c in ("sizes", "counts", "having") else np.frombuffer(b"".join(packed), np.uint8 if c == "low" else np.int64))
    return out


def shared_in(parts: int):
    def run(group: pa.Table) -> pa.Table:
        """Of one bucket: per set, the shingles that other sets have too, and how many sets have each."""
        bucket = group["bucket"][0].as_py()
        f1, f2, n, counts, low = joined(group, "f1", "f2", "sizes", "counts", "low")
        _, first = np.unique(np.stack([f1, f2]), axis=1, return_index=True)
        first.sort()
        begin = starts_of(counts)[first]
        f1, f2, n, counts = f1[first], f2[first], n[first], counts[first]
        flat = np.zeros((int(counts.sum()), 8), np.uint8)
        flat[:, :7] = low.reshape(-1, 7)[ranges(counts, begin)]
        h = flat.view("<i8").ravel() | ((bucket & 0xFF) << 56) - ((bucket & 0x80) << 57)
        del low, flat
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        lead = np.flatnonzero(new)
        times = np.diff(lead, append=len(h))
        having = np.empty(len(h), np.int64)
        having[order] = np.repeat(times, times)
        own = np.repeat(np.arange(len(f1)), counts)
        keep = np.flatnonzero(having > 1)
        part = f1[own[keep]] % parts
        keep = keep[np.argsort(part, kind="stable")]
        part.sort()
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keep))
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = keep[a:b]
            lead = np.flatnonzero(np.diff(own[x], prepend=-1))
            sets = own[x[lead]]
            rows.append((int(part[a]), f1[sets].tobytes(), f2[sets].tobytes(), squeeze(n[sets]), squeeze(np.diff(lead, append=b - a)), h[x].tobytes(), squeeze(having[x])))
        return pa.Table.from_batches([record(SHARED, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7)])

    return run


def most_alone(n, percent: int):
    """How many of n shingles another set need not have: those behind them are too few for a link."""
    return n - -(-percent * n // 100)


def gathered(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Sets that may link: their shared shingles under each order."""
        f1, f2, n, counts, h, having = joined(group, "f1", "f2", "sizes", "counts", "shingles", "having")
        own = np.repeat(np.arange(len(f1)), counts)
        sets, where = np.unique(np.stack([f1, f2]), axis=1, return_inverse=True)
        own = where.reshape(-1)[own]
        n_of = np.empty(sets.shape[1], np.int64)
        n_of[where.reshape(-1)] = n
        total = np.bincount(own, minlength=len(n_of))
        good = n_of - total <= most_alone(n_of, percent)
        keep = good[own]
        own, h, having = own[keep], h[keep], having[keep]
        order = np.lexsort((h, having, own))
        own, h, having = own[order], h[order], having[order]
        total, n_of, sets = total[good], n_of[good], sets[:, good]
        alone = n_of - total
        own = (np.cumsum(good) - 1)[own]
        rare = (alone + np.bincount(own, weights=1 / having, minlength=len(n_of))) / n_of
        prefix = most_alone(n_of, percent) + 1 - alone
        offsets = pa.array(np.append(0, np.cumsum(total)).astype(np.int32))
        others = []
        for salt in ORDERS:
            moved = mix(h.view(np.uint64) ^ np.uint64(salt)).view(np.int64)
            moved = moved[np.lexsort((moved, own))]
            ends = pa.array(np.append(0, np.cumsum(prefix)).astype(np.int32))
            others.append(pa.ListArray.from_arrays(ends, pa.array(moved[ranges(prefix, starts_of(total))])))
        return pa.Table.from_batches([record(SETS, [sets[0], sets[1], n_of, alone, rare, pa.ListArray.from_arrays(offsets, pa.array(h)), *others])])

    return run


def candidates(docs: DataFrame, width: int, percent: int, bucket_bytes: int, slice_bytes: int) -> DataFrame:
    """Distinct sets of which enough is shared with others, numbered."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // bucket_bytes))
    sets = (send(docs, width, buckets, slice_bytes).groupBy("bucket").applyInArrow(shared_in(buckets), SHARED)
            .groupBy("part").applyInArrow(gathered(percent), SETS))
    return stored(sets.withColumn("set", F.monotonically_increasing_id()))


def needed(a: Column, b: Column, percent: int) -> Column:
    """How many shingles sets of these sizes must share."""
    return F.ceil(percent * (a + b) / (100 + percent))


def met(a: str, b: str, percent: int) -> Column:
    """The pair's bound at a shingle at places ``pos`` of both: the sets' sizes and what stands behind allow a link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    behind = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * behind >= percent * (n + m))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (p, x) that pass the other orders and then share enough."""
    short = sets.select("set", "n", "alone", "second", "third")
    for side in ("p", "x"):
        pairs = pairs.join(short.select(F.col("set").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in short.columns[1:]]), side)
    must = needed(F.col("n_p"), F.col("n_x"), percent)

    def first(order: str, side: str) -> Column:
        return F.slice(f"{order}_{side}", F.lit(1), F.greatest(F.lit(0), F.col(f"n_{side}") - must + 1 - F.col(f"alone_{side}")).cast("int"))

    for order in ("second", "third"):
        pairs = pairs.where(F.arrays_overlap(first(order, "p"), first(order, "x")))
    pairs = stored(pairs.select("p", "x", "n_p", "n_x"))
    full = sets.select("set", "shingles")
    for side in ("p", "x"):
        pairs = pairs.join(full.select(F.col("set").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    both = F.size(F.array_intersect("s_p", "s_x"))
    return stored(pairs.where((100 + percent) * both >= percent * (F.col("n_p") + F.col("n_x"))).select("p", "x"))


def with_class(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return entries.withColumn("class", F.col("set"))
    return entries.join(found.select(F.col("doc").alias("set"), "class"), "set", "left").withColumn("class", F.coalesce("class", "set"))


def linked(sets: DataFrame, percent: int) -> DataFrame | None:
    """(doc, class): the class of every set that is linked with one of a smaller number; a class has its smallest set's number."""
    alike = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))  # places that sets of one size leave open
    prefix = (F.lit(1) + most_alone_column(percent) - F.col("alone")).cast("int")
    entries = sets.select("set", "n", "alone", "rare", alike.alias("alike"), F.posexplode(F.slice("shingles", F.lit(1), prefix)).alias("k", "shingle"))
    entries = stored(entries.select("shingle", "set", "n", "rare", (F.col("k") + F.col("alone")).alias("pos"), (F.col("k") + F.col("alone") <= F.col("alike")).alias("lead")))
    lists = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.max("lead").alias("some")).where("members > 1 and some")
    entries = stored(entries.join(lists.select("shingle"), "shingle", "left_semi"))
    found = links = None
    main = None  # per list, the pivot of the first round
    for round_ in range(2):
        e = with_class(entries, found)
        leads = e.where("lead")
        if main is not None:
            m = with_class(main.select("shingle", F.col("p").alias("set")), found).select("shingle", F.col("class").alias("main"))
            leads = leads.join(m, "shingle").where("class != main")
        top = leads.groupBy("shingle").agg(F.min(F.struct("rare", "set", "n", "pos", "class")).alias("p"))
        top = stored(top.select("shingle", F.col("p.set").alias("p"), F.struct("p.n", "p.pos").alias("a"), F.col("p.class").alias("p_class")))
        if round_ == 0:
            main = top
        y = e.select("shingle", F.col("set").alias("x"), "lead", F.struct("n", "pos").alias("b"), "class")
        pairs = y.join(top, "shingle").where((F.col("class") != F.col("p_class")) & (F.col("lead") | (F.col("b.n") >= F.col("a.n"))) & met("a", "b", percent))
        new = verified(in_order(pairs.select("p", "x")), sets, percent)
        if not new.isEmpty():
            links = new if found is None else new.unionByName(found.select(F.col("class").alias("p"), F.col("doc").alias("x")))
            found = stored(classes(links))
    rest = verified(in_order(between(with_class(entries, found), main, found, percent)), sets, percent)
    if not rest.isEmpty():
        found = stored(classes(rest if found is None else rest.unionByName(found.select(F.col("class").alias("p"), F.col("doc").alias("x")))))
    return found


def most_alone_column(percent: int) -> Column:
    return F.col("n") - F.ceil(percent * F.col("n") / 100)


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct()


def between(entries: DataFrame, main: DataFrame, found: DataFrame | None, percent: int) -> DataFrame:
    """(p, x): pairs of different classes that meet in a list and pass its bound, the smaller set leading."""
    m = with_class(main.select("shingle", F.col("p").alias("set")), found).select("shingle", F.col("class").alias("main"))
    lists = (entries.groupBy("shingle").agg(F.min(F.when(F.col("lead"), F.col("n"))).alias("least_n"), F.min("class").alias("c0"), F.max("class").alias("c1"))
             .where("c0 != c1").select("shingle", "least_n").join(m, "shingle"))
    e = entries.join(lists, "shingle").withColumn("other", F.col("class") != F.col("main"))
    # a set that could only be linked with smaller ones than the list has leads none
    low = F.greatest("least_n", F.ceil(percent * F.col("n") / 100))
    e = stored(e.where("lead").unionByName(e.where(~F.col("lead") & ((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + low))))
               .select("shingle", "set", "class", "lead", "other", F.struct("n", "pos").alias("at")))

    def side(name: str, at: str) -> list[Column]:
        return ["shingle", F.col("set").alias(name), F.col("class").alias(f"{name}_class"), F.col("at").alias(at)]

    out = None
    for p, x in (("other", "true"), ("not other", "other")):  # members of the main class do not meet each other
        pairs = (e.where(f"lead and {p}").select(*side("p", "a")).join(e.where(x).select(*side("x", "b")), "shingle")
                 .where((F.col("p_class") != F.col("x_class")) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("p") < F.col("x")))) & met("a", "b", percent)).select("p", "x"))
        out = pairs if out is None else out.unionByName(pairs)
    # the smaller set leads: pairs of the main class with a smaller set from outside are those of the first join
    return out


def components(docs: DataFrame, width: int = 4, percent: int = 85, bucket_bytes: int = 32 << 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    marked = stored(fingerprints(docs, width))
    sets = candidates(docs, width, percent, bucket_bytes, slice_bytes)
    found = linked(sets, percent)
    named = (marked.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least")).join(sets.select("f1", "f2", "set"), ["f1", "f2"], "left"))
    if found is None:
        ids = named.select("f1", "f2", F.col("least").alias("component_id"))
    else:
        named = stored(named.join(found.select(F.col("doc").alias("set"), "class"), "set", "left").withColumn("class", F.coalesce("class", "set")))
        of_class = named.where("class is not null").groupBy("class").agg(F.min("least").alias("component_id"))
        ids = named.join(of_class, "class", "left").select("f1", "f2", F.when(F.col("class").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = marked.join(ids, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
