"""What several operators share: tables, stored results, words of a text as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import shared_dir

#: Words are runs of anything but these; the same set that ``bytes.split()`` cuts at.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
LEAST_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage behind it, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def id_key(col: str = "doc_id") -> Column:
    """The id to order and join by; a null id counts as the smallest."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LEAST_ID))


def text_key(col: str = "text") -> Column:
    """Tells rows of one id apart by their text; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most_bytes`` of text, or one row where a single text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 ... base**(n-1) modulo 2**64 and their inverses; kept and grown."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(1 << 16, n + n // 8)
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for out, b in ((up, base), (down, pow(base, -1, 2**64))):
            out[0] = 1
            done = 1
            while done < n:
                step = min(done, n - done)
                np.multiply(out[:step], np.uint64(pow(b, done, 2**64)), out=out[done:done + step])
                done += step
        _POWERS[base] = have = (up, down)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and the number of words per text.

    Works on the UTF-8 buffer of the whole array: a word's hash is a polynomial over its
    bytes, taken from prefix sums, so no word becomes a Python object.  Null: no words.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    offsets = offsets - lo
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = ~space[edges]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[edges - 1] = ~space[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    h = (sums[last] - sums[first]) * down[first]
    counts = np.diff(np.searchsorted(first, offsets))
    return mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` words in a row, ends of texts not regarded."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n - width + 1])


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run begins, for runs of the given lengths one after the other."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)


class Recent(dict):
    """A bounded cache of two generations: what is used stays, what is not is forgotten.

    When ``most`` entries are in, they become the old generation and the one before goes; an
    old entry that is asked for again moves up.  Forgetting costs time only.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
