"""Substring dedup: repeated windows of words, merged into maximal removal intervals.

Every window of ``width`` words gets a Rabin-Karp hash; windows are counted by hash over the whole
input, and every window but the first of its hash (smallest doc_id, then start) is removed.

What is shuffled is one packed row per (slice of the input, bucket), and back per slice.  A slice sends each of its
window hashes once, with its first place there; further places in the slice are known to be repeats
on the spot.  So a passage that a third of all documents share costs one entry per slice, not per
document.  A second, independent hash chooses the bucket, and the number of buckets grows with the
bytes of the input: the bits that tell two windows apart are 64 plus the logarithm of the buckets.

Null text: no words.  Null doc_id: smaller than any id.  Rows of one doc_id that differ in text are
kept apart, but neither counts as earlier than the other at equal starts; rows equal in both give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import chunks, id_key, mix, partitions, rolling, starts_of, text_key, word_hashes

FIRST, SECOND = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
PACKED = "bucket int, slice bigint, local boolean, ids binary, keys binary, counts binary, starts binary, hashes binary"


def squeeze(x: np.ndarray) -> bytes:
    """Small numbers without their empty upper bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()) if len(x) else b""


def unsqueeze(b: bytes) -> np.ndarray:
    import zstandard

    if not b:
        return np.empty(0, np.int64)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed(bucket: int, slice_: int, local: bool, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, start: np.ndarray, hashes: np.ndarray | None) -> tuple:
    """Entries in the order of their rows; starts as steps within the row."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    steps = np.diff(start, prepend=0)
    steps[first] = start[first]
    return (bucket, slice_, local, ids[row[first]].tobytes(), keys[row[first]].tobytes(), squeeze(np.diff(first, append=len(row))), squeeze(steps),
            b"" if hashes is None else hashes.tobytes())


def unpacked(ids: bytes, keys: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row ids and keys, the row of each entry, its start."""
    n = unsqueeze(counts)
    row = np.repeat(np.arange(len(n)), n)
    steps = np.cumsum(unsqueeze(starts))
    at = starts_of(n)
    before = np.where(at > 0, steps[at - 1], 0) if len(n) else at
    return np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), row, steps - np.repeat(before, n)


def send(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[list[tuple]]:
    for batch in chunks(batches, "text", 2 << 20):
        order = np.argsort(batch["_id"].to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        ids, keys = batch["_id"].to_numpy(), batch["_key"].to_numpy()
        words, counts = word_hashes(batch["text"])
        if len(words) < width:
            continue
        row = np.repeat(np.arange(len(ids)), counts)
        start = np.arange(len(words)) - np.repeat(starts_of(counts), counts)
        whole = np.flatnonzero(row[:len(words) - width + 1] == row[width - 1:])
        if not len(whole):
            continue
        h = rolling(words, width, FIRST)[whole]
        bucket = (rolling(mix(words + np.uint64(1)), width, SECOND)[whole] % np.uint64(buckets)).astype(np.int32)
        row, start = row[whole], start[whole]
        order = np.lexsort((h, bucket))
        same = (h[order][1:] == h[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        first = order[np.flatnonzero(np.diff(group, prepend=-1))][group]
        again = (ids[row[order]] != ids[row[first]]) | (start[order] != start[first])
        out = []
        own = int(ids[0] * 31 + keys[0])  # ties what comes back to this slice; two slices of one number do no harm
        here = np.sort(order[again])
        if len(here):
            out.append(packed(int(bucket[here[0]]), own, True, ids, keys, row[here], start[here], None))
        rest = np.sort(order[~again])
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[rest], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(rest)], strict=True):
            x = rest[a:b]
            out.append(packed(int(bucket[x[0]]), own, False, ids, keys, row[x], start[x], h[x]))
        yield out


def repeats(group: pa.Table) -> pa.Table:
    """Of one bucket: per row that a slice sent, its windows that are not the first of their hash."""
    parts, hashes, slices = [], [], group["slice"].to_numpy()
    at = 0
    for n, (local, ids, keys, counts, starts, h) in enumerate(zip(*(group[c].to_pylist() for c in ("local", "ids", "keys", "counts", "starts", "hashes")), strict=True)):
        i, k, row, start = unpacked(ids, keys, counts, starts)
        parts.append((i, k, row + at, start, np.full(len(row), local), np.full(len(row), n, np.int32)))
        hashes.append(np.zeros(len(row), np.uint64) if local else np.frombuffer(h, np.uint64))
        at += len(i)
    ids, keys, row, start, local, sent_in = (np.concatenate(x) for x in zip(*parts, strict=True))
    h = np.concatenate(hashes)
    del parts, hashes
    sent = np.flatnonzero(~local)
    order = sent[np.argsort(h[sent])]
    same = h[order][1:] == h[order][:-1]
    shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    later = shared
    if len(shared):
        shared = shared[np.lexsort((start[shared], ids[row[shared]], h[shared]))]
        lead = np.flatnonzero(np.concatenate([[True], h[shared][1:] != h[shared][:-1]]))
        first = shared[np.repeat(lead, np.diff(lead, append=len(shared)))]
        later = shared[(ids[row[shared]] != ids[row[first]]) | (start[shared] != start[first])]
    gone = np.sort(np.concatenate([np.flatnonzero(local), later]))  # entries stand in the order of sender, row, start
    out = []
    for part in np.split(gone, np.flatnonzero(np.diff(sent_in[gone])) + 1) if len(gone) else []:
        out.append(packed(0, int(slices[sent_in[part[0]]]), True, ids, keys, row[part], start[part], None)[1:7])
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, REPLY_KINDS, strict=True)], names=REPLY_NAMES)


REPLY = "slice bigint, local boolean, ids binary, keys binary, counts binary, starts binary"
REPLY_NAMES = [c.split()[0] for c in REPLY.split(", ")]
REPLY_KINDS = (pa.int64(), pa.bool_(), *[pa.binary()] * 4)


def merged(width: int):
    """Of one slice: all its windows to remove, as maximal intervals per document."""
    def run(group: pa.Table) -> pa.Table:
        parts = [unpacked(*x) for x in zip(*(group[c].to_pylist() for c in ("ids", "keys", "counts", "starts")), strict=True)]
        ids, keys, start = (np.concatenate([p[0][p[2]] for p in parts]), np.concatenate([p[1][p[2]] for p in parts]), np.concatenate([p[3] for p in parts]))
        order = np.lexsort((start, keys, ids))
        ids, keys, start = ids[order], keys[order], start[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
        begin = np.flatnonzero(new | np.concatenate([[True], np.diff(start) > width]))
        end = np.append(begin[1:], len(start)) - 1
        cuts = np.flatnonzero(new[begin])
        offsets = pa.array(np.append(cuts, len(begin)).astype(np.int32))
        first = begin[cuts]
        return pa.table({"_id": pa.array(ids[first]), "_key": pa.array(keys[first]),
                         "begins": pa.ListArray.from_arrays(offsets, pa.array(start[begin].astype(np.int32))),
                         "ends": pa.ListArray.from_arrays(offsets, pa.array((start[end] + width).astype(np.int32)))})

    return run


def repeated_windows(docs: DataFrame, width: int = 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(_id, _key, begins, ends): the words to remove, as intervals."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // bucket_bytes))
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = (pa.int32(), *REPLY_KINDS, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in send(batches, width, buckets):
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at:at + 64], strict=True), kinds, strict=True)], names=names)

    return (docs.select(id_key().alias("_id"), text_key().alias("_key"), "text").mapInArrow(run, PACKED)
            .groupBy("bucket").applyInArrow(repeats, REPLY)
            .groupBy("slice").applyInArrow(merged(width), "_id bigint, _key bigint, begins array<int>, ends array<int>"))


def dedup(docs: DataFrame, width: int = 20, bucket_bytes: int = 16 << 20, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts`` also the kept words and the intervals."""
    gone = repeated_windows(docs, width, bucket_bytes).groupBy("_id", "_key").agg(
        F.flatten(F.collect_list("begins")).alias("_begins"), F.flatten(F.collect_list("ends")).alias("_ends"))
    d = docs.select("doc_id", "text", id_key().alias("_i"), text_key().alias("_k"))
    d = d.join(gone, (d["_i"] == gone["_id"]) & (d["_k"] == gone["_key"]), "left").select("doc_id", "text", "_begins", "_ends")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if texts:
        schema += ", kept string, removed array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            begins, ends = batch["_begins"], batch["_ends"]
            for n, (i, t) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                words = (t or "").encode().split()
                spans: list[list[int]] = []
                kept = words
                if begins[n].is_valid:
                    keep = np.ones(len(words), bool)
                    for a, b in zip(begins[n].as_py(), ends[n].as_py(), strict=True):
                        keep[a:b] = False
                    edge = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=1, append=1))
                    spans = edge.reshape(-1, 2).tolist()
                    kept = list(compress(words, keep))
                joined = b" ".join(kept)
                out.append((i, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *((joined.decode(), spans) if texts else ())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32())))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    return d.mapInArrow(run, schema)
