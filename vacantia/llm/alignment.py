"""Cross-tokenizer alignment: where two vocabularies end a token at the same byte.

Texts are shuffled whole, so that each distinct text is tokenised and aligned once; its pair counts
are weighted by its copies and its measures joined back to the doc_ids.

Distinct texts are worked off in slices of a few megabytes.  A slice is stored as one row: per text
its measures, and its linked id pairs as places in the slice's list of distinct pairs.  What is
counted over the corpus is one row per (slice, pair), summed before it is shuffled, so a pair that
stands everywhere costs one row a slice; the counts come back to the slice by the same rows.

Texts that are null or empty, or whose tokens do not give back space+text byte by byte, have no tokens:
zeros and an empty ``groups_sha256``.  An empty table gives an empty result.  A text may be of any length that the
tokenizers take.  Repeated rows, and rows of a null or repeated doc_id, each get their text's measures;
where two A ids tie for a B id's highest count, links of both are best.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.bpe import PIECES, byte_letters
from vacantia.llm.common import chunks, starts_of, stored

SLICES = ("slice bigint, keys array<binary>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>,"
          " pairs array<bigint>, weights array<bigint>, places binary, times binary, held array<bigint>")
MEASURES = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
#: A linked pair is one number: A's id above, B's id in the lower bits.
SHIFT = 32
LONG = 50_000
LONG_BLANK = re.compile(rf"\s{{{LONG}}}")


class Aligner:
    """Both vocabularies, the bytes of their tokens and their ids as text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        made = [ranks[bytes(back[c] for c in (m.replace(" ", "") if isinstance(m, str) else "".join(m)))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{a_path}: ids do not follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for word, i in ranks.items():
            self.a_bytes[i] = word
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        if b"" in ranks or b"" in self.b_bytes:
            raise ValueError("a token without bytes has no place in a text")
        self.a_length, self.b_length = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        # ids with the sign that follows them: A within a group, A last, B within, B last
        signs = [f"{i}{s}" for s, n in ((",", len(self.a_bytes)), ("|", len(self.a_bytes)), (",", len(self.b_bytes)), (";", len(self.b_bytes))) for i in range(n)]
        self.signs = np.array(signs, "S")

    def a_ids(self, text: str) -> list[int]:
        if len(text) > LONG and LONG_BLANK.search(text):  # more than the faster library's pattern search can hold
            return self.slow().encode(" " + text, add_special_tokens=False).ids
        return self.a.encode_ordinary(" " + text)

    @lru_cache(maxsize=1)
    def slow(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a_ids(t) for t in texts], self.b.encode(texts, num_threads=1)

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_groups, groups_sha256); the pair of every link and the text it stands in."""
        a_ids, b_ids = self.ids(texts)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a_ids[k])) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids[k])) != whole:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a_ids, b_ids))
        a, b = (np.fromiter((i for x in xs for i in x), np.int64, int(n.sum())) for xs, n in ((a_ids, n_a), (b_ids, n_b)))
        del a_ids, b_ids
        if not len(a):
            return [(0, 0, 0, "")] * len(texts), np.empty(0, np.int64), np.empty(0, np.int64)
        # all texts in a row: those that count have equal bytes in both, so ends never meet across texts
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.zeros(int(a_end[-1]) + 1, bool)
        ends[a_end] = True
        b_last = ends[b_end]
        ends[:] = False
        ends[b_end] = True
        a_last = ends[a_end]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_in, b_in = np.bincount(a_group), np.bincount(b_group)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + starts_of(b_in)[a_group]] = a + a_last * len(self.a_bytes)
        order[np.arange(len(b)) + (starts_of(a_in) + a_in)[b_group]] = 2 * len(self.a_bytes) + b + b_last * len(self.b_bytes)
        width = self.signs.dtype.itemsize
        written = memoryview(self.signs[order].tobytes())
        text_of = np.repeat(np.arange(len(texts)), n_a)[a_last]
        n_groups = np.bincount(text_of, minlength=len(texts))
        rows, at = [], 0
        for k, n in enumerate((n_a + n_b).tolist()):
            said = bytes(written[at * width:(at + n) * width]).translate(None, b"\0")[:-1]
            rows.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), hashlib.sha256(said).hexdigest() if n else ""))
            at += n
        return rows, (a[a_last] << SHIFT) | b[b_last], text_of


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def sliced(texts: DataFrame, a_path: Callable[[], str], b_path: Callable[[], str], slice_bytes: int) -> DataFrame:
    """Slices of distinct ``texts`` (key, text, copies), aligned."""
    names = [c.split()[0] for c in SLICES.split(", ")]
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.list_(pa.binary()), longs, longs, longs, pa.list_(pa.string()), longs, longs, pa.binary(), pa.binary(), longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_paths = aligner(a_path(), b_path())
        own = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", slice_bytes):
            rows, pairs, text_of = with_paths.align(batch["text"].to_pylist())
            distinct, place = np.unique(pairs, return_inverse=True)
            held, times = np.unique(text_of * max(1, len(distinct)) + place, return_counts=True)
            text, place = np.divmod(held, max(1, len(distinct)))
            weights = np.zeros(len(distinct), np.int64)
            np.add.at(weights, place, times * batch["copies"].to_numpy()[text])
            n_a, n_b, n_groups, shas = zip(*rows, strict=True)
            row = (own, batch["key"].to_pylist(), n_a, n_b, n_groups, shas, distinct, weights, place.astype("<u4").tobytes(), times.astype("<u4").tobytes(),
                   np.bincount(text, minlength=len(rows)))
            own += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return texts.select("key", "text", "copies").mapInArrow(run, SLICES)


def pair_counts(requests: DataFrame) -> DataFrame:
    """Of every pair: how many links hold it, and whether no other pair of its B id has more."""
    counts = requests.groupBy("pair").agg(F.sum("weight").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def measured(key: tuple, slices: pa.Table, reply: pa.Table) -> pa.Table:
    """Measures of a slice's texts from the corpus counts of its pairs."""
    del key
    if not slices.num_rows:
        return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(MEASURES.split(", "), (pa.binary(), *[pa.int64()] * 6, pa.string()), strict=True)})
    row = {c: slices[c][0] for c in slices.column_names}
    pairs = row["pairs"].values.to_numpy()
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.searchsorted(pairs, reply["pair"].to_numpy())
    count[at], best[at] = reply["count"].to_numpy(), reply["best"].to_numpy()
    place, times = (np.frombuffer(row[c].as_py(), "<u4").astype(np.int64) for c in ("places", "times"))
    held = row["held"].values.to_numpy()
    text = np.repeat(np.arange(len(held)), held)
    n_links, n_best, count_sum = np.zeros((3, len(held)), np.int64)
    np.add.at(n_links, text, times)
    np.add.at(n_best, text, times * best[place])
    np.add.at(count_sum, text, times * count[place])
    return pa.table([row["keys"].values, row["n_a"].values, row["n_b"].values, row["n_groups"].values, pa.array(n_links), pa.array(n_best), pa.array(count_sum), row["groups_sha256"].values],
                    names=[c.split()[0] for c in MEASURES.split(", ")])


def aligned(docs: DataFrame, a_path: Callable[[], str], b_path: Callable[[], str], slice_bytes: int = 4 << 20) -> DataFrame:
    """Per document: tokens of both vocabularies, groups, links, and how common the linked pairs are."""
    key = F.unhex(F.sha2("text", 256))
    texts = docs.where(F.col("text") != "").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(key.alias("key"), "text", "copies")
    slices = stored(sliced(texts, a_path, b_path, slice_bytes))
    zipped = slices.select(F.col("slice").alias("to"), F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    requests = zipped.select("to", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("weight"))
    reply = requests.select("to", "pair").join(pair_counts(requests), "pair").select("to", "pair", "count", "best")
    per_text = slices.drop("weights").groupBy("slice").cogroup(reply.groupBy("to")).applyInArrow(measured, MEASURES)
    out = docs.select("doc_id", key.alias("_key")).join(per_text, F.col("_key") == F.col("key"), "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def pair_table(docs: DataFrame, a_path: Callable[[], str], b_path: Callable[[], str], slice_bytes: int = 4 << 20) -> DataFrame:
    """The alignment itself: a_id, b_id, how many links of the corpus hold the pair, whether it is B's best."""
    texts = docs.where(F.col("text") != "").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(F.lit(b"").alias("key"), "text", "copies")
    slices = sliced(texts, a_path, b_path, slice_bytes).select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    counts = pair_counts(slices.select(F.col("p.pairs").alias("pair"), F.col("p.weights").alias("weight")))
    return counts.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"), "count", "best")
