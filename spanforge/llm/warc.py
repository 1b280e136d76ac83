"""Web archives (WARC 1.1) of Zstandard frames: one frame for each record, and a dictionary in front.

An archive starts with a skippable frame that holds the dictionary (itself compressed or not), then comes one frame for
each record, so any record is decoded alone. The reader walks frames by their headers and block sizes, loads the
dictionary, decodes a frame at a time, and checks what a record says of itself: version, mandatory fields, length, end,
digests of block and payload, and the length in the HTTP header. A task of the writer trains the dictionary on its
first TRAIN_BYTES of payloads, and closes an archive after ARCHIVE_BYTES.

Of equal payloads (same SHA-256) of at least `least` bytes, one is kept as a response; the others become revisit
records, which name it and hold the HTTP header only. Archives are values of a Parquet table, which any store that
Spark knows can hold; `save` writes them as files into a folder that all executors have mounted, and `load` reads files
from any store.

Defined results: a null payload counts as empty; the response is the row of the largest id, null being the smallest
(of repeated ids, any one row); revisits of a response without id have a null refers_to; control characters, spaces and
non-ASCII characters of a URL are percent-encoded, a null one leaves the field out; ids come back in their own type (a
simple one); an empty table gives no archives; other columns are not carried. A record or frame that is not as it should
be gives a row with `error`, or fails the job with `strict`.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, fields, join_keyed, map_batches, spent

#: Fixed values of the format: magic numbers of frames, of the dictionary's frame and of a plain dictionary.
FRAME, SKIPPABLE, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0xEC30A437
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads that a dictionary is trained on, its size, bytes after which an archive is closed, and the most that a record may hold.
TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, RECORD_BYTES = 1 << 19, 1 << 15, 4 << 20, 1 << 30
#: The date of records of pages that have none.
DATE = "1970-01-01T00:00:00Z"

RECORD = "archive string, id string, record_id string, record_type string, url string, refers_to string, refers_to_record string, payload_bytes long, payload_digest string, payload binary, error string"


class Malformed(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- records


def record(kind: str, record_id: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), *more, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(name: str, row: int, page_id: str | None, url: str | None, payload: bytes, of: tuple[int, str | None] | None) -> bytes:
    """A response, or a revisit of the page (row, id) that has the same payload."""
    more = [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~"))] if url is not None else []
    more += [("WARC-Page-ID", quote(page_id))] if page_id is not None else []
    if of is not None:
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_uuid(name, of[0])}>")]
        more += [("WARC-Refers-To-Page-ID", quote(of[1]))] if of[1] is not None else []
    more += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("response" if of is None else "revisit", record_uuid(name, row), http + (payload if of is None else b""), more)


def record_uuid(name: str, row: int | str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{row}"))


def _header(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of a header and what comes after it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Malformed("no end of a header")
    found: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Malformed("a header line without a name")
        found[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found, rest


def _length(head: dict[str, str]) -> int:
    value = head.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise Malformed("no valid Content-Length")
    return int(value)


def _checked(said: str | None, data: bytes, what: str) -> None:
    if said is not None and said.lower().startswith("sha1:") and said[5:] != sha1_base32(data):
        raise Malformed(f"{what} digest differs")


def parse_record(data: bytes) -> dict:
    """The record's columns (of RECORD, without archive); Malformed if anything it says is wrong."""
    if not data.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n")):
        raise Malformed("no version line")
    head, rest = _header(data)
    if missing := [m for m in MANDATORY if not head.get(m.lower())]:
        raise Malformed(f"no {missing[0]}")
    block, end = rest[: (n := _length(head))], rest[n:]
    if len(block) < n or end != b"\r\n\r\n":
        raise Malformed("Content-Length differs from the record's")
    _checked(head.get("warc-block-digest"), block, "block")
    kind, digest, payload, size = head["warc-type"], head.get("warc-payload-digest"), block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, payload = _header(block)
        size = _length(http) if "content-length" in http else len(payload)
        if kind == "response" and size != len(payload):
            raise Malformed("the HTTP header's length differs from the payload's")
    if kind == "response":
        _checked(digest, payload, "payload")
    elif kind == "revisit" and not (digest and head.get("warc-profile") and head.get("warc-refers-to")):
        raise Malformed("a revisit that doesn't name what it revisits")
    bare = lambda v: None if v is None else v.strip("<>").removeprefix("urn:uuid:")
    named = lambda v: None if v is None else unquote(v)
    return {
        "id": named(head.get("warc-page-id")), "record_id": bare(head["warc-record-id"]), "record_type": kind, "url": head.get("warc-target-uri"),
        "refers_to": named(head.get("warc-refers-to-page-id")), "refers_to_record": bare(head.get("warc-refers-to")), "payload_bytes": size,
        "payload_digest": digest.partition(":")[2] if digest else sha1_base32(payload), "payload": payload if kind != "revisit" else None, "error": None,
    }


# ---------------------------------------------------------------- frames


def skippable(data: bytes, magic: int = DICTIONARY_FRAME) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def frames(data: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """Magic number and bytes of each frame (of a skippable one, its content), found without decoding any."""
    data, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < 8:
            raise Malformed("cut-off frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + size
            if end > len(data):
                raise Malformed("cut-off frame")
            yield magic, data[at + 8 : end]
        elif magic == FRAME:
            end = _frame_end(data, at)
            yield magic, data[at:end]
        else:
            raise Malformed("no frame where one should start")
        at = end


def _frame_end(data: memoryview, start: int) -> int:
    try:
        told = zstandard.get_frame_parameters(data[start : start + 18])
        at = start + zstandard.frame_header_size(data[start : start + 18])
    except zstandard.ZstdError as e:
        raise Malformed("cut-off frame") from e
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
        if at > len(data) or kind == 3:
            raise Malformed("cut-off frame")
    at += 4 if told.has_checksum else 0
    if at > len(data):
        raise Malformed("cut-off frame")
    return at


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as the leading frame holds it: plain, or compressed."""
    if content[:4] == struct.pack("<I", FRAME):
        content = _decoded(zstandard.ZstdDecompressor(), content)
    if content[:4] != struct.pack("<I", DICTIONARY):
        raise Malformed("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """One frame's content, of at most RECORD_BYTES."""
    try:
        size = zstandard.frame_content_size(frame)
        if size >= 0:
            if size > RECORD_BYTES:
                raise Malformed("a record beyond the limit")
            return decoder.decompress(frame)
        with decoder.stream_reader(frame) as stream:
            found = stream.read(RECORD_BYTES + 1)
    except zstandard.ZstdError as e:
        raise Malformed(f"undecodable frame: {e}") from e
    if len(found) > RECORD_BYTES:
        raise Malformed("a record beyond the limit")
    return found


def records(data: bytes, strict: bool = False) -> Iterator[dict]:
    """parse_record of each of an archive's records. What can't be read gives a row with its error; after an unreadable
    frame's end nothing more can be found."""
    none = dict.fromkeys(["id", "record_id", "record_type", "url", "refers_to", "refers_to_record", "payload_bytes", "payload_digest", "payload"])
    decoder, known, first = zstandard.ZstdDecompressor(), 0, True
    walk = frames(data)
    while True:
        try:
            if (found := next(walk, None)) is None:
                return
            magic, frame = found
            if magic == DICTIONARY_FRAME and first:
                dictionary = load_dictionary(bytes(frame))
                decoder, known = zstandard.ZstdDecompressor(dict_data=dictionary), dictionary.dict_id()
            elif magic == FRAME:
                if (named := zstandard.get_frame_parameters(frame[:18]).dict_id) not in (0, known):
                    raise Malformed(f"frame of dictionary {named}, not {known}")
                yield parse_record(_decoded(decoder, bytes(frame)))
            first = False
        except Malformed as e:
            if strict:
                raise
            first = False
            yield none | {"error": str(e)}


class Writer:
    """Records as frames of an archive, all by one dictionary."""

    def __init__(self, samples: list[bytes], level: int = 3):
        self.front, self.dictionary = b"", None
        try:
            size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
            self.dictionary = zstandard.train_dictionary(size, samples, k=1024, d=8)
            self.front = skippable(zstandard.compress(self.dictionary.as_bytes()))
        except (zstandard.ZstdError, ValueError, MemoryError):
            self.dictionary = None  # too little to learn from: frames without one
        self.encoder = zstandard.ZstdCompressor(level=level, dict_data=self.dictionary, write_checksum=True)

    def frame(self, data: bytes) -> bytes:
        return self.encoder.compress(data)


# ---------------------------------------------------------------- tables


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, name: str = "urn:spanforge:pages") -> DataFrame:
    """The table of archives: archive (its file name), n_records, data."""
    text = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = cut(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text.alias("payload"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row")))
    able = rows.where(F.octet_length("payload") >= least)
    kept = cut(able.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n")))
    told = join_keyed(able, kept, "digest", "n").unionByName(rows.where(F.octet_length("payload") < least).withColumn("best", F.lit(None).cast(kept.schema["best"].dataType)))
    of = F.when(F.col("best.row") != F.col("row"), F.struct(F.col("best.row").alias("row"), F.col("best.id").cast("string").alias("id")))
    schema = fields("archive string, n_records long, data binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting, held, writer, done, size = TaskContext.get().partitionId(), 0, [], 0, None, [], 0

        def closed() -> pa.RecordBatch:
            file = f"{part:05d}-{number:05d}.warc.zst"
            info = record("warcinfo", record_uuid(name, file), b"format: WARC File Format 1.1\r\n", [("WARC-Filename", file), ("Content-Type", "application/warc-fields")])
            return pa.RecordBatch.from_pydict({"archive": [file], "n_records": [len(done)], "data": [b"".join([writer.front, writer.frame(info), *done])]}, schema=arrow)

        def packed(ready: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal done, size, number
            for row, page_id, url, payload, other in ready:
                done.append(writer.frame(page_record(name, row, page_id, url, payload, other)))
                size += len(done[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    done, size, number = [], 0, number + 1

        for batch in batches:
            for i in range(batch.num_rows):
                row, page_id, url, payload, other = (c[i].as_py() for c in batch.columns)
                waiting.append((row, page_id, url, payload.encode("utf-8"), (other["row"], other["id"]) if other else None))
                held += len(waiting[-1][3])
                if writer is None and held >= TRAIN_BYTES:
                    writer = Writer([p for _, _, _, p, _ in waiting if p])
                if writer is not None:
                    yield from packed(waiting)
                    waiting = []
        if waiting:
            writer = writer or Writer([p for _, _, _, p, _ in waiting if p])
            yield from packed(waiting)
        if done:
            yield closed()

    out = cut(told.select("row", F.col("id").cast("string").alias("id"), "url", "payload", of.alias("of")).mapInArrow(run, schema), compression="uncompressed")
    spent(rows, kept)
    return out


def read(archives: DataFrame, strict: bool = False, payloads: bool = True) -> DataFrame:
    """RECORD's columns for each record of archives (archive, data)."""
    schema = fields(RECORD)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for found in records(data.as_py(), strict):
                    size += len(found["payload"] or b"")
                    held.append({"archive": archive.as_py()} | found | ({} if payloads else {"payload": None}))
                    if size > 8 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return archives.select("archive", "data").mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """read()'s responses and revisits (a written table's), each with its full payload."""
    pages = found.where(F.col("record_type").isin("response", "revisit"))
    times = cut(pages.where("record_type = 'revisit'").groupBy(F.col("refers_to_record").alias("record_id")).agg(F.count(F.lit(1)).alias("n")))
    heads = cut(pages.where("record_type = 'response'").join(times, "record_id").select(F.col("record_id").alias("refers_to_record"), "n", F.col("payload").alias("whole")))
    again = join_keyed(pages.where("record_type = 'revisit'"), heads, "refers_to_record", "n").withColumn("payload", F.col("whole")).drop("whole")
    return pages.where("record_type = 'response'").unionByName(again)


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that all executors have mounted; archive, bytes. A retried task writes the same again."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = []
        for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = f"{folder}/.{archive}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                sizes.append(f.write(data.as_py()))
            os.replace(own, f"{folder}/{archive}")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64())], names=["archive", "bytes"])

    return cut(map_batches(archives.select("archive", "data"), lambda: step, fields("archive string, bytes long"), rows=16))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Archives from files of any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def revisit_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """A row for each page, read back from its archive: id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id_col].dataType
    found = read(write(pages, id_col, url_col, payload_col, least), strict=True, payloads=False).where(F.col("record_type").isin("response", "revisit"))
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
