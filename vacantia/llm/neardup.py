"""Near duplicates: consistent weighted sampling over TF-IDF word shingles, banded and verified.

1. A shingle is five words; its weight in a document is how often it comes there times the mean
   inverse document frequency of its words.  Frequencies are counted over all documents, in a
   fixed number of hashed word buckets, so the table has one size for any corpus.  (Frequencies
   of whole shingles would take weight from whatever many copies share, and large groups of near
   copies would fall below the threshold because they are large.)
2. Improved consistent weighted sampling draws ``bands * rows`` samples (shingle, t) per document;
   two documents agree in a sample with the probability of their weighted Jaccard similarity.
3. Equal texts become one node.  Nodes that agree in all samples of a band meet in a bucket.  No
   bucket is expanded into pairs: its members are compared with one pivot, the member that meets
   most others over all bands (the original among its copies).  A member that is not linked with
   the pivot is open.  For a link between two members of a pivot's family one of these must hold:
   (a) They share some weight that the pivot does not have.  Taken in one order, before all that
       the pivot has, their first common shingle stands where at most 1 - least of either text's
       weight is passed (prefix filtering).  Each comparison returns these few shingles as keys;
       members meet again by (pivot, key), where pivots (1, then 8, 64, ... of the open ones)
       are compared with all members of other classes until each open one was a pivot or the
       rest of its group is one class, but for pairs whose weights inside and outside of the
       family's pivot bound their similarity below ``least``.  Links are contracted each round.
   (b) All they share is in the pivot.  Then the weights they have in common with it bound their
       similarity, and only pairs whose bound reaches ``least`` are compared.
   Texts that share most words with one original, and with each other only through it, thus
   do not meet again, however many there are.
4. A comparison computes the exact weighted Jaccard similarity of the two texts.
5. Links are contracted to classes by alternating star steps; every step is a stored table.

Words are compared as they are.  A text of one to four words is one shingle; texts without words
(null ones too) are copies of each other.  White space does not tell texts apart.  Rows of one
doc_id count as one document only if their texts are equal; else, and without an id (which counts
as the smallest), each text is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import LEAST_ID, chunks, id_key, mix, powers, rolling, starts_of, stored, text_key, word_hashes

WORD_BITS, TABLE_BITS = 16, 14
SHINGLE, WHOLE = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
NODE = "struct<_id:bigint,_a:bigint,_b:bigint>"


def node_key() -> Column:
    """A document: its id and 128 bits of its text; in this order the first one of a class stays."""
    return F.struct(id_key().alias("_id"), text_key().alias("_a"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_b"))


@dataclass(frozen=True)
class Sampler:
    """Samples of consistent weighted sampling; its tables of random values follow from the seed."""

    n: int
    seed: int = 7

    def tables(self) -> tuple[np.ndarray, ...]:
        rng = np.random.default_rng(self.seed)
        size = 1 << TABLE_BITS
        r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        return r, (1 / r).astype(np.float32), np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32), rng.random(size, dtype=np.float32), rng.integers(0, 2**64, self.n, dtype=np.uint64)

    def draw(self, shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of samples per document with shingles; the runs of ``counts`` must not be empty."""
        r, inv, lnc, beta, seeds = self.tables()
        starts = starts_of(counts)
        lnw = np.log(weights).astype(np.float32)
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.empty((len(counts), self.n), np.uint64)
        low = np.uint64((1 << TABLE_BITS) - 1)
        for k, seed in enumerate(seeds):
            y = (shingles ^ seed) * np.uint64(0x9FB21C651E98DF25)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0xA0761D6478BD642F)
            b = beta[(y >> np.uint64(22)) & low]
            i = (y >> np.uint64(36)) & low
            t = np.floor(lnw * inv[i] + b)
            z = lnc[y >> np.uint64(64 - TABLE_BITS)] - r[i] * (t - b + np.float32(1))
            hit = np.flatnonzero(z == np.minimum.reduceat(z, starts)[owner])
            hit = hit[np.diff(owner[hit], prepend=-1) > 0]
            out[:, k] = mix(shingles[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


@dataclass(frozen=True)
class Shingler:
    """Distinct shingles of texts with their weights, by the corpus-wide idf of hashed words."""

    idf: np.ndarray
    width: int = 5

    def of(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Shingles (sorted within a text), weights, distinct shingles per text; words, words per text; weight of one occurrence."""
        words, n_words = word_hashes(texts)
        n = np.where(n_words >= self.width, n_words - self.width + 1, (n_words > 0).astype(n_words.dtype))
        idf = self.idf[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        owner = np.repeat(np.arange(len(n_words)), n_words)
        sums = np.concatenate([[0.0], np.cumsum(idf)])
        if len(words) >= self.width:
            h = rolling(words, self.width, SHINGLE)
            inside = np.flatnonzero(owner[:len(h)] == owner[self.width - 1:])
            # words are counted from each text's start, so that equal shingles get equal weights to the last bit
            w = sum(idf[j:len(h) + j] for j in range(self.width)) / self.width
            h, w, doc = h[inside], w[inside], owner[inside]
        else:
            h, w, doc = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
        short = np.flatnonzero((n_words > 0) & (n_words < self.width))
        if len(short):
            first = starts_of(n_words)[short]
            last = first + n_words[short]
            h = np.concatenate([h, whole_hash(words, first, last, SHINGLE)])
            w = np.concatenate([w, (sums[last] - sums[first]) / n_words[short]])
            doc = np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, w, doc = h[order], w[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(at, append=len(h))
        counts = np.bincount(doc[at], minlength=len(n)) if len(at) else np.zeros(len(n), np.int64)
        return h[at], w[at] * times, counts, words, n_words, w[at]


def whole_hash(words: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """One hash over all words from ``first`` to ``last``."""
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Smoothed idf per hashed word bucket, over all documents: 1 + ln((1 + n) / (1 + df))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << WORD_BITS) + 1, np.int64)
        for batch in chunks(batches, text, 2 << 20):
            words, counts = word_hashes(batch[text])
            owner = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
            seen = np.unique((owner << np.uint64(WORD_BITS)) | (words >> np.uint64(64 - WORD_BITS)))
            df[:-1] += np.bincount((seen & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), minlength=1 << WORD_BITS)
            df[-1] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 65,537 rows at most
    df = np.zeros((1 << WORD_BITS) + 1)
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return 1 + np.log((1 + df[-1]) / (1 + df[:-1]))


def signatures(docs: DataFrame, shingler: Shingler, bands: int, rows: int) -> DataFrame:
    """(doc, d1, d2, bands): a 128-bit digest of the words and one hash per band."""
    sampler = Sampler(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            h, w, counts, words, n_words, _ = shingler.of(batch["text"])
            first = starts_of(n_words)
            d1 = whole_hash(words, first, first + n_words, WHOLE)
            d2 = whole_hash(mix(words + np.uint64(3)), first, first + n_words, SHINGLE)
            some = np.flatnonzero(counts)
            samples = np.zeros((len(counts), bands), np.uint64)
            if len(some):
                drawn = sampler.draw(h, w, counts[some])
                for band in range(bands):
                    x = np.full(len(some), band, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        x = mix(x * np.uint64(0x2545F4914F6CDD1D) + drawn[:, k])
                    samples[some, band] = x
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(d1.astype(np.int64)), pa.array(d2.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(samples.ravel().astype(np.int64))), pa.array(counts > 0)],
                names=["doc", "d1", "d2", "bands", "some"])

    return docs.select(node_key().alias("doc"), "text").mapInArrow(run, f"doc {NODE}, d1 bigint, d2 bigint, bands array<bigint>, some boolean")


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of ``n`` rows while a job with two texts a row runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def similarities(pairs: DataFrame, texts: DataFrame, shingler: Shingler, least: float, keys: bool = False) -> DataFrame:
    """(p, x, similarity) of pairs; the text of x moves to where p's is, and Spark splits a p with very many.

    ``keys`` adds the weight of x, the weight common to both, and the first shingles of x (as the
    upper half of their hashes; the rarest words first) with weight that p does not have, until they pass 1 - least of x.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for part in batch["p"].flatten():
                new[1:] |= np.diff(part.to_numpy()) != 0
            lead = np.cumsum(new) - 1
            hp, wp, np_, *_ = shingler.of(batch["p_text"].filter(pa.array(new)))
            hx, wx, nx, _, _, ux = shingler.of(batch["x_text"])
            sp, sx = np.concatenate([[0], np.cumsum(np_)]), np.concatenate([[0], np.cumsum(nx)])
            sim, size, common = np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
            found = []
            for k in range(len(x)):
                a, b = slice(sp[lead[k]], sp[lead[k] + 1]), slice(sx[k], sx[k + 1])
                base = np.zeros(nx[k])
                if np_[lead[k]]:
                    at = np.searchsorted(hp[a], hx[b])
                    at[at == np_[lead[k]]] = 0
                    base = np.where(hp[a][at] == hx[b], np.minimum(wp[a][at], wx[b]), 0.0)
                size[k], common[k] = wx[b].sum(), base.sum()
                total = wp[a].sum() + size[k] - common[k]
                sim[k] = common[k] / total if total else 1.0
                if keys:
                    rest = wx[b] - base
                    own = np.flatnonzero(rest > 0)
                    own = own[np.lexsort((hx[b][own], -ux[b][own]))]
                    n = np.searchsorted(np.cumsum(rest[own]), size[k] * (1 - least + 1e-9), "right") + 1
                    found.append(np.unique(hx[b][own[:n]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            out = {"p": batch["p"], "x": x, "similarity": pa.array(sim)}
            if keys:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                out |= {"size": pa.array(size), "common": pa.array(common), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))}
            yield pa.RecordBatch.from_pydict(out)

    px = pairs.join(texts.select(F.col("doc").alias("x"), F.col("text").alias("x_text")), "x")
    both = px.join(texts.select(F.col("doc").alias("p"), F.col("text").alias("p_text")), "p").select("p", "x", "p_text", "x_text")
    with arrow_rows(pairs.sparkSession, 256):
        return stored(both.mapInArrow(run, f"p {NODE}, x {NODE}, similarity double" + ", size double, common double, keys array<int>" * keys))


def in_order(pairs: DataFrame) -> DataFrame:
    """Every pair once, the smaller document first."""
    return pairs.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct()


def families(members: DataFrame, texts: DataFrame, shingler: Shingler, least: float) -> DataFrame:
    """(p, x, similarity, size, common, keys, open): the members of each bucket compared with its densest one."""
    top = members.groupBy("band", "h").agg(F.min(F.struct((-F.col("dense")).alias("dense"), "doc")).alias("_p"))
    pairs = members.join(top.select("band", "h", F.col("_p.doc").alias("p")), ["band", "h"]).filter("doc != p")
    out = similarities(pairs.select("p", F.col("doc").alias("x")).distinct(), texts, shingler, least, keys=True)
    return out.withColumn("open", F.col("similarity") < least)


def by_bound(family: DataFrame, least: float, step: float = 0.05) -> DataFrame:
    """(p, x): members of one family, one of them open, that may be linked by what both share with the pivot."""
    loose = family.filter(F.col("common") >= F.col("size") * (least - 1e-9)).select(F.col("p").alias("f"), "x", "size", "common", "open")
    most = F.col("common") * ((1 + least) / least) - F.col("size")
    low = F.floor(F.log(F.col("size") * (least - 1e-9)) / step)
    x = loose.filter("open").filter(most >= F.col("size") * (least - 1e-9)).select("f", F.col("x").alias("p"), F.col("size").alias("p_size"), F.col("common").alias("p_common"), F.explode(F.sequence(low, F.floor(F.log(most) / step))).alias("bin"))
    y = loose.withColumn("bin", F.floor(F.log("size") / step)).drop("open")
    enough = F.least("common", "p_common") * (1 + least) >= (F.col("size") + F.col("p_size")) * (least - 1e-9)
    return x.join(y, ["f", "bin"]).filter(enough & (F.col("p") != F.col("x"))).select("p", "x")


def linked(nodes: DataFrame, docs: DataFrame, shingler: Shingler, least: float) -> DataFrame:
    """(doc, class): the classes of the nodes that are linked with another one."""
    rows = nodes.filter("some").select(F.col("rep").alias("doc"), F.posexplode("bands").alias("band", "h"))
    full = rows.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(rows.join(full, ["band", "h"]).distinct())
    members = met.join(met.groupBy("doc").agg(F.sum("n").alias("dense")), "doc")
    # one row per document, copies go before the shuffle; the ids that meet grow with the documents: merged at every size, never broadcast
    copies = docs.select(node_key().alias("doc"), "text").groupBy("doc").agg(F.first("text").alias("text"))
    texts = stored(copies.join(met.select("doc").distinct().hint("merge"), "doc", "left_semi"))
    compared = families(members, texts, shingler, least)
    tried = in_order(compared)
    links = compared.filter(~F.col("open")).select("p", "x").distinct()

    undone = compared.groupBy("p").agg(F.count("*").alias("_n"), F.max("open").alias("_o")).filter("_o and _n > 1").select("p")
    family = compared.join(undone, "p", "left_semi")
    more = similarities(in_order(by_bound(family, least)).join(tried, ["p", "x"], "left_anti"), texts, shingler, least)
    tried = tried.unionByName(in_order(more))
    links = links.unionByName(more.filter(F.col("similarity") >= least).select("p", "x"))

    keyed = family.select(F.col("p").alias("f"), F.col("x").alias("doc"), "open", "size", "common", F.explode("keys").alias("key"))
    shared = keyed.groupBy("f", "key").agg(F.count("*").alias("n"), F.max("open").alias("_o"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("_h")).filter("_o and n > 1")
    shared = shared.groupBy("f", "n", "_h").agg(F.min("key").alias("key")).select("f", "key")  # one of the keys that the same members share
    again = stored(keyed.join(shared, ["f", "key"]).distinct())
    texts = stored(texts.join(again.select("doc").distinct(), "doc", "left_semi"))
    most = F.least("common", "p_common") + F.least(F.col("size") - F.col("common"), F.col("p_size") - F.col("p_common"))
    enough = most * (1 + least) >= (F.col("size") + F.col("p_size")) * (least - 1e-9)
    found, rest, pivots_each = classes(links), again, 1
    while True:
        # between members of one class nothing is left to find
        rest = rest.drop("class").join(found, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
        split = rest.groupBy("f", "key").agg(F.min("class").alias("_a"), F.max("class").alias("_b")).filter("_a < _b").select("f", "key")
        rest = stored(rest.join(split, ["f", "key"], "left_semi"))
        slot = rest.filter("open").withColumn("_s", F.pmod(F.xxhash64("doc"), F.lit(pivots_each)))
        chosen = slot.groupBy("f", "key", "_s").agg(F.min("doc").alias("doc")).select("f", "key", "doc")
        pivots = stored(chosen.join(rest, ["f", "key", "doc"]).select("f", "key", F.col("doc").alias("p"), F.col("class").alias("p_class"), F.col("size").alias("p_size"), F.col("common").alias("p_common")))
        if pivots.isEmpty():
            return found
        pairs = rest.join(pivots, ["f", "key"]).filter((F.col("class") != F.col("p_class")) & enough).select("p", F.col("doc").alias("x"))
        more = similarities(in_order(pairs).join(tried, ["p", "x"], "left_anti"), texts, shingler, least)
        tried = tried.unionByName(in_order(more))
        new = more.filter(F.col("similarity") >= least).select("p", "x")
        if not new.isEmpty():
            found = classes(found.select(F.col("class").alias("p"), F.col("doc").alias("x")).unionByName(new))
        # a pivot has met all of its group that were of other classes; the others stay, linked or not
        rest = rest.join(pivots.select("f", "key", F.col("p").alias("doc")), ["f", "key", "doc"], "left_anti")
        pivots_each *= 8


def classes(links: DataFrame) -> DataFrame:
    """(doc, class): the smallest document of each connected part, by large-star and small-star steps."""
    edges = stored(links.select(F.col("x").alias("u"), F.col("p").alias("v")))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = stored(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("class"))
        before = now


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """(doc, d1, d2, class): the class of every row of ``docs``, named by its smallest document.

    A pair at the threshold of 0.8 meets in some band with probability 1 - (1 - 0.8**rows)**bands,
    0.999 with the given numbers.
    """
    shingler = Shingler(word_idf(docs), width)
    signed = stored(signatures(docs, shingler, bands, rows))
    nodes = stored(signed.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("some").alias("some")))
    found = linked(nodes, docs, shingler, least)
    named = nodes.join(found, F.col("rep") == F.col("doc"), "left").select("d1", "d2", F.coalesce("class", "rep").alias("class"))
    return signed.select("doc", "d1", "d2").join(named, ["d1", "d2"])


def classified(docs: DataFrame, **how) -> DataFrame:
    """doc_id and class_id, one row per row of ``docs``.

    A class has the id of its smallest document; where that is null or the smallest of several
    classes (an id that stands for different texts), a negative number made of its text.
    """
    out = stored(near_duplicates(docs, **how).select("doc._id", "class"))
    twice = out.select("class").distinct().groupBy(F.col("class._id").alias("_t")).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | (F.col("_t") == LEAST_ID)).select("_t")
    number = F.when(F.col("_t").isNull(), F.col("class._id")).otherwise(-1 - F.shiftrightunsigned("class._a", 1))
    return out.join(twice, F.col("class._id") == F.col("_t"), "left").select(F.nullif("_id", F.lit(LEAST_ID)).alias("doc_id"), number.alias("class_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Of each class the document with the smallest doc_id, columns unchanged; of rows equal in id and text one."""
    heads = stored(near_duplicates(docs, **how).select(F.col("class").alias("doc")).distinct())
    rows = docs.select(node_key().alias("doc"), F.struct(*docs.columns).alias("row")).groupBy("doc").agg(F.first("row").alias("row"))
    return rows.join(heads, "doc", "left_semi").select("row.*")
