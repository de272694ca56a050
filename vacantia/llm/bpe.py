"""Byte-level BPE encoding and decoding.

A piece (what the vocabulary's own pattern cuts out) is merged with a segment tree: leaf i holds
rank * width + i for the pair that begins at symbol i, a node the minimum of its children, so the
root is the leftmost pair of the lowest rank.  A merge changes at most three leaves and the path
above each, so a piece of n symbols takes O(n log n), however long it is.

Texts are encoded where they lie: no shuffle.  Pieces met before come from a bounded cache in the
Python worker; what is not in it is merged again, so the bound costs time and never changes a result.
Null text: empty.  Other columns are left out; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import Recent, chunks

#: Fixed by byte-level vocabularies: how a text is cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such a vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Codec:
    """A vocabulary file, its merges by rank, and the added tokens that are never cut."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *added.values()])
        self.bytes_of = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word)
        for word, i in added.items():
            self.bytes_of[i] = word.encode()
        self.names = [str(i) for i in range(size)]
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.find = regex.compile(PIECES).findall
        self.cache = Recent(cache)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        width = 1 << n.bit_length()
        none = 1 << 62
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            found = pairs.get((ids[i], ids[i + 1]))
            if found:
                tree[leaves + i] = found[0] * width + i
        for k in range(leaves - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low

        while (root := tree[1]) != none:
            i = root % width
            j = right[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            after = right[i] = right[j]
            if j < n - 1:
                put(j, none)
            if after < n:
                left[after] = i
                found = pairs.get((ids[i], ids[after]))
                put(i, found[0] * width + i if found else none)
            else:
                put(i, none)
            before = left[i]
            if before >= 0:
                found = pairs.get((ids[before], ids[i]))
                put(before, found[0] * width + before if found else none)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, merge = self.cache, self.merge
        cache.turn()
        old = cache.old
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.added[part])
                continue
            for piece in self.find(part):
                ids = cache.get(piece)
                if ids is None:
                    ids = old.get(piece)
                    if ids is None:
                        ids = tuple(merge(piece.encode()))
                    if len(piece) <= 64:  # longer ones hardly come again
                        cache[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def code_texts(docs: DataFrame, path: Callable[[], str], columns: str, row: Callable, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``row(codec, id, text)`` of every document; ``columns`` is the schema of what it gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path())
        for batch in chunks(batches, text):
            made = [row(c, i, t or "") for i, t in zip(batch[key].to_pylist(), batch[text].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(columns)
    kinds, names = [to_arrow_type(f.dataType) for f in schema], schema.names
    return docs.select(key, text).mapInArrow(run, columns)


def encode(docs: DataFrame, path: Callable[[], str]) -> DataFrame:
    """doc_id and its token ids."""
    return code_texts(docs, path, "doc_id bigint, ids array<int>", lambda c, i, t: (i, c.encode(t)))


def decode(coded: DataFrame, path: Callable[[], str]) -> DataFrame:
    """doc_id and the text of its token ids; null ids: an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path())
        for batch in batches:
            texts = [c.decode(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: Callable[[], str]) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass that moves no ids."""
    def row(c: Codec, i: int | None, t: str) -> tuple:
        ids = c.encode(t)
        return (i, len(ids), hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(c.decode(ids).encode()).hexdigest())

    return code_texts(docs, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
