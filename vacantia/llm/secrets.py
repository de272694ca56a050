"""Secret scans: patterns, and novelty against a primed compressor.

Patterns give the base spans.  Beyond them, every token-like string whose line names a sensitive
thing is compressed with Zstandard primed by a dictionary: the identifiers every code base has and
the text around the string, without the string itself and without its other copies, which would
make it known.  What that text already says costs next to nothing; a string that still costs most
of what random characters of its alphabet need is random by all that is known, and reported.  Equal
strings of one text get one verdict.

Whole texts are read where they lie; no shuffle.  Null text: empty.  Repeated rows are scanned one
by one.  Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from vacantia.llm.common import chunks

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a run has no other hex digit beside it
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|credential|bearer|authorization|private.?key|access.?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIERS = ("authorization bearer token access_token refresh_token id_token session_token client_secret client_id "
               "api_key apikey secret_key secretKey private_key public_key password passwd username user_name "
               "credentials environment config settings default example placeholder changeme your_token_here "
               "getElementById addEventListener application/json content-type https://www. http://localhost "
               "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 self.assertEqual import return function "
               "public static void final String boolean integer unsigned request response header timestamp").encode()


def alphabet(string: str) -> int:
    """Size of the alphabet that the string's longest run of letters and digits is from: 16, 32, 36 or 64."""
    run = max(re.findall(r"[A-Za-z0-9]+", string), key=len)
    if len(run) < 20:
        run = string
    return next((n for n, of in ((16, "[0-9a-f]+|[0-9A-F]+"), (32, "[A-Z2-7]+|[a-z2-7]+"), (36, "[0-9a-z]+|[0-9A-Z]+")) if re.fullmatch(of, run)), 64)


def without(text: str, start: int, end: int, string: str) -> str:
    """``text`` from ``start`` to ``end`` without what belongs to a copy of ``string``."""
    out, at = [], start
    k = text.find(string, max(0, start - len(string) + 1), end + len(string))
    while 0 <= k < end:
        out.append(text[at:k])
        at = max(at, k + len(string))
        k = text.find(string, k + 1, end + len(string))
    return "".join([*out, text[at:end]])


class Novelty:
    """Marginal compressed bytes of a string, given the text around it."""

    def __init__(self, around: int = 1024, level: int = 3) -> None:
        import zstandard

        self.z, self.around, self.level = zstandard, around, level

    def cost(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds, per character; the empty frame is taken off."""
        value = text[start:end].rstrip("=").rpartition("=")[2]  # name=value: another copy may stand without the name
        value = value if len(value) >= 20 else text[start:end]
        known = IDENTIFIERS + "".join(without(text, a, b, value) for a, b in ((max(0, start - self.around), start), (end, end + self.around))).encode("utf-8", "replace")
        primed = self.z.ZstdCompressionDict(known, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        press = self.z.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        return (len(press.compress(text[start:end].encode())) - len(press.compress(b""))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, leftmost and not overlapping within a kind."""
    found = []
    if could_assign(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def could_assign(text: str) -> bool:
    """Whether the assign pattern could match at all: it needs one of these and a sign."""
    if "=" not in text and ":" not in text:
        return False
    low = text.lower()
    return "passw" in low or "secret" in low or "token" in low or "api" in low


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, least: float = 0.7, near: int = 80) -> list[tuple[int, int, int]]:
    """Candidates within ``near`` characters behind a sensitive word that no base span touches.

    ``least`` is in bytes a character of base64, and less in proportion for smaller alphabets.
    """
    places = [m.start() for m in SENSITIVE.finditer(text)]
    if not places:
        return []
    out, at, verdicts = [], 0, {}
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at + 1 < len(places) and places[at + 1] < s:
            at += 1
        if not 0 <= s - places[at] <= near or any(a < e and s < b for a, b, _ in taken):
            continue
        string = m[0]
        if not any(c.isdigit() for c in string) or not any(c.isalpha() for c in string):
            continue
        if string not in verdicts:
            verdicts[string] = novelty.cost(text, s, e) >= least * math.log2(alphabet(string)) / 6
        if verdicts[string]:
            out.append((s, e, 3))
    return out


def spans_of(text: str, novelty: Novelty, least: float = 0.7, near: int = 80) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, novelty, least, near), key=lambda x: (x[0], x[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.7, near: int = 80) -> DataFrame:
    """doc_id, number of spans per kind, digest of the base spans, and all spans as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in chunks(batches, text):
            counts: list[list[int]] = [[], [], [], []]
            digests, shown = [], []
            for t in batch[text].to_pylist():
                base, every = spans_of(t or "", novelty, least, near)
                for k in range(4):
                    counts[k].append(sum(x[2] == k for x in every))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                shown.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch[key].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(key, text).mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", least: float = 0.7, near: int = 80) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; other columns and clean texts stay as they are."""
    names = docs.columns
    place = names.index(text)

    def clean(t: str | None, novelty: Novelty) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, _ in spans_of(t, novelty, least, near)[1]:
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]]) if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in chunks(batches, text):
            columns = list(batch.columns)
            columns[place] = pa.array([clean(t, novelty) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))
