"""Packing documents into sequences: bounded-space online best fit.

Tokens are counted where the texts lie; only one narrow row per piece is shuffled.  Each packing
task sees its rows in a fixed order and keeps at most ``open_bins`` bins open.  A bitset has bit f
set where a bin with f free places is open: the tightest bin that takes a piece is the lowest set
bit at or above its length.  Where none takes it and all bins are open, the fullest one closes.
Bins still open at a task's end give their pieces to a second, smaller round, and so on while
rounds get smaller, so the part-filled bins do not grow with the number of tasks.

Null text: empty (its end token alone).  Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.bpe import byte_letters
from vacantia.llm.common import Recent, chunks, starts_of, stored

CACHE = 400_000
#: How a vocabulary has to cut and lower words for ``Merger`` to give its ids.
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Words of these characters have one form, one lower case and one kind per character in every library.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{LETTERS}]*")
PLAIN_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^{LETTERS}0-9\n]+")
END = "\0"
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Merger:
    """Ids of plain words by a faster library from the same vocabulary.

    A piece of a word is merged with an end sign after it, which stands for the vocabulary's end-of-word suffix: the sign
    joins the last byte before anything else merges.  Words that are not ``plain`` go to tokenizers itself.
    """

    def __init__(self, spec: dict) -> None:
        import tiktoken

        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        back = {c: bytes([b]) for b, c in byte_letters().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {b"".join(back[c] for c in w.removesuffix(suffix)) + (END.encode() if w.endswith(suffix) else b""): i for w, i in model["vocab"].items()
                 if w not in self.special}
        made = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        first = {model["vocab"][c + x] for c in back for x in ("", suffix)}
        if made != sorted(set(made)) or len(first) + len(made) != len(ranks) or max(first) > made[0]:
            raise ValueError("ids do not follow the order of merges")
        self.core = tiktoken.Encoding("words", pat_str=rf"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for w, i in ranks.items() if w.endswith(END.encode()) and len(w) > 1]] = True

    @staticmethod
    def of(path: str) -> Merger | None:
        """A merger for the vocabulary in ``path``, if it is one of those that it can stand for."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        model = {k: spec["model"].get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")}
        if (spec["normalizer"] != {"type": "Sequence", "normalizers": LOWERS} or spec["pre_tokenizer"] != cut or spec["post_processor"]
                or model.pop("type") != "BPE" or any(model.values()) or not spec["model"].get("end_of_word_suffix")):
            return None
        try:
            return Merger(spec)
        except (KeyError, ValueError):
            return None

    def plain(self, words: list[str]) -> list[str]:
        whole = "".join(words)
        marked = any(t in "\n".join(words) for t in self.special)
        if PLAIN.fullmatch(whole) and not marked:
            return words
        return [w for w in words if PLAIN.fullmatch(w) and not (marked and any(t in w for t in self.special))]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of plain words as bytes."""
        if not words:
            return []
        cut = PLAIN_CUT.findall("\n".join(words).lower())
        pieces = list(set(cut) - {"\n"})
        place = dict(zip(pieces, range(len(pieces))))
        place["\n"] = len(pieces)
        ids = np.array(self.core.encode_ordinary(END.join([*pieces, ""])), "<u4")
        ends = np.append(np.flatnonzero(self.ends[ids]) + 1, len(ids))  # the line end between two words has no ids
        sizes = np.diff(ends, prepend=0)
        at = np.fromiter(map(place.__getitem__, cut), np.int64, len(cut))
        data = ids[spans((ends - sizes)[at], sizes[at])].tobytes()
        to = 4 * np.append(np.cumsum(sizes[at])[at == len(pieces)], sizes[at].sum())
        return [data[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(starts - starts_of(sizes), sizes) + np.arange(int(sizes.sum()))


class WordCoder:
    """Ids of a text as little-endian bytes, word by word.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those of
    its parts between blanks, tabs and line ends; parts come from a bounded cache.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = Recent(cache)
        self.merger = Merger.of(path)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        known = {}
        if self.merger:
            plain = self.merger.plain(words)
            known = dict(zip(plain, self.merger.encode(plain), strict=True))
            words = [w for w in words if w not in known] if len(plain) < len(words) else []
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return known | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, got, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), "[\n\t\r]", " "), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary.to_pylist()
        cache = self.cache
        cache.turn()
        new = [w for w in words if w not in cache and w not in cache.old]
        if new:
            cache.update(self.learn(new))
        held = [cache[w] for w in words]
        # the ids of each distinct word once, then those of every word in its place
        ids, sizes = np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        data = ids[spans(starts_of(sizes)[at], sizes[at])].tobytes()
        ends = 4 * np.append(0, np.cumsum(sizes[at]))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces(docs: DataFrame, path: Callable[[], str], size: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``size`` only where it is longer."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path())
        for batch in chunks(batches, text, 2 << 20):
            rows: list[tuple] = []
            for i, ids in zip(batch[key].to_pylist(), c.encode([t or "" for t in batch[text].to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * at:4 * (at + size)]
                    rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, PIECE)


class Bins:
    """At most ``most`` open bins of ``size`` places; ``items`` of a bin are what was put in."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.free = 0
        self.bins: dict[int, list[list]] = {}
        self.open = 0

    def put(self, item: tuple, length: int) -> list | None:
        """Place an item; a bin that this closed, if any."""
        if length == self.size:
            return [item]
        closed = None
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open >= self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            room, bin_ = self.size, []
        bin_.append(item)
        if room == length:
            return bin_
        self.bins.setdefault(room - length, []).append(bin_)
        self.free |= 1 << (room - length)
        self.open += 1
        return closed

    def _take(self, room: int) -> list:
        at = self.bins[room]
        bin_ = at.pop()
        if not at:
            del self.bins[room]
            self.free &= ~(1 << room)
        self.open -= 1
        return bin_

    def rest(self) -> Iterator[list]:
        for room in sorted(self.bins):
            yield from self.bins[room]


PACKED = PIECE + ", sequence_id bigint, offset bigint, done boolean"


def pack_round(rows: DataFrame, tasks: int, size: int, open_bins: int, last: bool, base: int) -> DataFrame:
    """One round over ``tasks`` tasks; ``done`` is false for pieces of bins that were still open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = base + (TaskContext.get().partitionId() << 40)
        bins, out = Bins(size, open_bins), []

        def give(bin_: list, done: bool) -> None:
            nonlocal number
            at = 0
            for item in bin_:
                out.append((*item, number, at, done))
                at += item[3]
            number += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                              names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"])
            out.clear()
            return made

        for batch in batches:
            for item in zip(*(batch[k].to_pylist() for k in ("doc_id", "piece", "start", "length", "ids_crc32")), strict=True):
                closed = bins.put(item, item[3])
                if closed:
                    give(closed, True)
            yield flush()
        for bin_ in bins.rest():
            give(bin_, last)
        yield flush()

    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"]
    dealt = rows.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")) if tasks > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, PACKED)


def pack(docs: DataFrame, path: Callable[[], str], size: int = 2048, end_id: int = 0, open_bins: int = 1024,
         rows_per_task: int = 20_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece with its sequence and its place there.

    The number of tasks follows from the counted pieces; a later round has what the open bins of
    the round before held, at most ``open_bins`` bins a task, and an eighth of its tasks.
    """
    columns = [c.split()[0] for c in PIECE.split(", ")]
    todo = stored(pieces(docs, path, size, end_id, text, key))
    tasks = max(1, -(-todo.count() // rows_per_task))
    done, base = None, 0
    while True:
        last = tasks <= 2
        made = stored(pack_round(todo.select(*columns), tasks, size, open_bins, last, base))
        part = made.filter("done").select(*columns, "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo, tasks, base = made.filter("not done"), -(-tasks // 8), base + (1 << 60)
