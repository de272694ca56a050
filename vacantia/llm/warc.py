"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds the dictionary (itself compressed), built from
the records that the archive holds; then comes one frame per record, so each can be read alone.
Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the
response, the others are revisits that name it and carry no payload; all others are responses.

Archives are files in the shared folder, written under a name that no other attempt of the task
uses; the rows of the attempt that counts name its files, and only those are read back.

Null html: an empty payload.  Null url: no target.  Null page_id: smaller than any id, and read
back as null; only records with an id are referred to.  Repeated rows of one id and payload refer
to nothing but another id, so all of them are responses.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import stored
from vacantia.session import shared_dir

#: Fixed by the format: skippable frame number 0x5D, and the frames' magic.
SKIPPABLE, ZSTD_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
#: Bytes of an archive that are given to the decompressor at a time.
STEP = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page_id: int | None) -> str:
    """A record's name; it holds the id, so a reference can be read back."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) | page_id % (1 << 64))}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(int=0)}>"


def page_of(name: str) -> int | None:
    n = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if not n >> 127:
        return None
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; the block is the HTTP answer, of a revisit its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}",
              "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """Trained on records spread evenly over the archive, up to ``sample_bytes`` of them.

    Too few or too small records give no trained dictionary; then the longest record's head serves.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[:1 << 17] for r in records[::step]]
    try:
        if len(sample) >= 8:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, sample)) // 8)), sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        pass
    return max(records, key=len)[:min(size, 4096)].ljust(8, b" ")


def archive(records: list[bytes], size: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3) -> bytes:
    import zstandard

    words = dictionary(records, size, sample_bytes)
    packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(words)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
    return b"".join([SKIPPABLE, len(packed).to_bytes(4, "little"), packed, *map(press.compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by its own dictionary."""
    import zstandard

    if data[:4] != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    end = 8 + int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdDecompressor().decompress(data[8:end])
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = memoryview(data)[end:]
    while len(rest):
        if bytes(rest[:4]) != ZSTD_MAGIC:
            raise ValueError("a frame with an unknown magic")
        # in short runs: what lies behind a frame is copied, and may be the rest of the archive
        one, parts, at = plain.decompressobj(), [], 0
        while not one.eof:
            if at >= len(rest):
                raise ValueError("a frame that does not end")
            parts.append(one.decompress(rest[at:at + STEP]))
            at += STEP
        yield b"".join(parts)
        rest = rest[min(at, len(rest)) - len(one.unused_data):]


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def file_system(uri: str):
    """A file system and path for a shared folder given as a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def marked(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, and the page that a revisit refers to.

    Only digests and ids are counted and joined; the largest id per payload comes from an
    aggregation with a map-side part, and Spark splits a payload that very many pages share.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"),
                        F.length(payload).alias("bytes"))


def last_of(rows: DataFrame, least: int) -> DataFrame:
    """The response of each payload that more than one page has."""
    return (rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
            .filter("n > 1").select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "last"))


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write archives of about ``archive_bytes`` before compression; one row per file: path, records."""
    spark = pages.sparkSession
    folder = (folder or f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}").rstrip("/")
    rows = marked(pages)
    last = last_of(rows.select("page_id", "digest", "bytes"), least)
    joined = (rows.join(last, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
              .select("page_id", "url", "payload", "digest", F.when(F.col("last") > F.coalesce("page_id", F.lit(-(2**63))), F.col("last")).alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        disk, base = file_system(folder)
        disk.create_dir(base, recursive=True)
        held: list[bytes] = []
        bytes_held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal bytes_held, number
            name = f"{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst"
            with disk.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(archive(held))
            made = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "records"])
            held.clear()
            bytes_held, number = 0, number + 1
            return made

        for batch in batches:
            for i, url, payload, digest, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(i.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
                bytes_held += len(held[-1])
                if bytes_held >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return stored(joined.mapInArrow(run, "path string, records bigint"))


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives named in ``files``; each is read whole where it is parsed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                disk, at = file_system(path)
                with disk.open_input_stream(at, compression=None) as f:
                    data = f.read()
                out: list[tuple] = []
                for raw in records_of(data):
                    fields, block = parsed(raw)
                    head, _, body = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    kind = fields["WARC-Type"]
                    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers,
                                *((body if kind == "response" else None,) if payloads else ())))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False)], names=names[:len(cols)])

    spread = files.select("path").repartition(max(1, files.count()))
    return spread.mapInArrow(run, READ + (", payload binary" if payloads else ""))
