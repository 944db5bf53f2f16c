"""WARC archives of Zstandard frames: a writer and a validating reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is one frame with that dictionary.  Spark's text writer
puts the frames into the shared file system, whatever that is: its line
separator is an empty skippable frame, so what it leaves is a plain sequence
of Zstandard frames.  Pages are dealt in turn to so many
archives that they hold ``ARCHIVE_BYTES`` of payload on average; an archive is
read whole by one task.

The reader takes the dictionary from the leading frame, decodes one frame for
each record, and raises on a bad magic number, a frame that doesn't end where
it should, a missing header, a block that isn't as long as Content-Length
says, and payloads that don't match their digest.

Records: a page is an HTTP response.  Of records with equal payloads of at
least ``LEAST_SHARED`` bytes that with the largest page_id is kept as response;
the others are revisits, which carry only the HTTP head and point to it.

Defined results: null html counts as empty; a null page_id comes back null and
is a response unless another record with an id has its payload; several rows
with the largest id are all responses; a null url is an empty target; repeated rows give repeated records; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import batches_of, materialize, shared_dir, small_batches

LEAST_SHARED = 1000
ARCHIVE_BYTES = 32_000_000
#: The dictionary comes from at most so many pages (least hashes first), of so many characters each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 32_768
LEVEL = 3
#: Groups of equal payloads up to this number (70 bytes each) are sent to all executors; beyond it they are joined.
SENT_GROUPS = 200_000
FRAME, DICTIONARY_FRAME = b"\x28\xb5\x2f\xfd", struct.pack("<I", 0x184D2A5D)
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = "P*M\x18\0\0\0\0"


class BadArchive(ValueError):
    pass


# ---- records -----------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    kind: str
    page_id: int | None
    url: str
    payload_bytes: int
    digest: str  # SHA-1 in hex
    refers_to: int | None
    payload: bytes  # empty for revisits


def _identity(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _number(identity: str) -> int | None:
    body = identity.removeprefix("<urn:page:").removesuffix(">")
    return None if body == "none" else int(body)


def pack_record(r: Record) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload if r.kind == "response" else b"")
    sha = base64.b32encode(bytes.fromhex(r.digest)).decode()
    head = [f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_identity(r.page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response"]
    if r.kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identity(r.refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _head(data: bytes, first: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].split(b"\r\n")
    if end < 0 or not lines[0].startswith(first):
        raise BadArchive(f"no {first.decode()} header")
    pairs = [x.partition(b":") for x in lines[1:]]
    return {k.decode().strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in pairs}, end + 4


def read_record(data: bytes) -> Record:
    head, start = _head(data, b"WARC/1.")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-target-uri"} - head.keys():
        raise BadArchive(f"missing {sorted(missing)}")
    size = int(head["content-length"])
    if len(data) != start + size + 4 or data[-4:] != b"\r\n\r\n":
        raise BadArchive("the record isn't as long as its Content-Length says")
    http, body = _head(data[start : start + size], b"HTTP/1.")
    payload, kind = data[start + body : start + size], head["warc-type"]
    length, digest = int(http["content-length"]), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive("the payload doesn't match its length and digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise BadArchive(f"a {kind} record that isn't well formed")
    return Record(kind, _number(head["warc-record-id"]), head["warc-target-uri"], length, digest, _number(head["warc-refers-to"]) if kind == "revisit" else None, payload)


# ---- archives ----------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_FRAME + struct.pack("<I", len(dictionary)) + dictionary


def records(archive: bytes) -> Iterator[Record]:
    import zstandard

    if archive[:4] != DICTIONARY_FRAME:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack_from("<I", archive, 4)[0]
    at = 8 + size
    dictionary = archive[8:at]
    if len(dictionary) != size:
        raise BadArchive("the dictionary is cut off")
    if dictionary[:4] == FRAME:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while at < len(archive):
        magic = archive[at : at + 4]
        if len(magic) == 4 and 0x50 <= magic[0] <= 0x5F and magic[1:] == FRAME_SKIP:
            if len(archive) < at + 8:
                raise BadArchive("a skippable frame is cut off")
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            if at > len(archive):
                raise BadArchive("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise BadArchive("no frame where one should start")
        one = reader.decompressobj()
        out, step = io.BytesIO(), 1 << 16
        while not one.eof:
            if at >= len(archive):
                raise BadArchive("a frame is cut off")
            part = archive[at : at + step]
            try:
                out.write(one.decompress(part))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            at += len(part)
        at -= len(one.unused_data)
        yield read_record(out.getvalue())


FRAME_SKIP = b"\x2a\x4d\x18"


def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> bytes:
    """Of a bounded sample; empty if that is too small for one."""
    import zstandard

    hashed = pages.where("html <> ''").withColumn("h", F.xxhash64("page_id", "html"))
    # First the hashes alone: every task sends its least ones, so rows with texts would add up with the tasks.
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= last).select(F.substring("html", 1, chars).alias("html")).limit(rows).collect() if last is not None else []
    texts = sorted({r["html"].encode("utf-8", "surrogatepass") for r in some})
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(rows: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Archives of rows(page_id, url, payload, payload_bytes, digest, refers_to, kind) in a new shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_frame(dictionary)], pa.binary())], names=["frame"])
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                out = []
                for r in batch.slice(start, 16).to_pylist():
                    url = " ".join((r["url"] or "").split())
                    out.append(made.compress(pack_record(Record(r["kind"], r["page_id"], url, r["payload_bytes"], r["digest"], r["refers_to"], r["payload"] or b""))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    spark = rows.sparkSession
    size = rows.agg(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + 400)).first()[0] or 0
    parts = max(1, -(-size // archive_bytes))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    frames = rows.repartition(parts).mapInArrow(run, "frame binary")
    with batches_of(spark, 64):
        frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


RECORDS = "kind string, page_id long, url string, payload_bytes long, digest string, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """One row for each record of the archives in a folder; the payloads are checked, and left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[Record]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([getattr(r, n) for r in rows], t) for n, t in zip(names, kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                held: list[Record] = []
                for r in records(batch.column(0)[i].as_py()):
                    held.append(Record(r.kind, r.page_id, r.url, r.payload_bytes, r.digest, r.refers_to, b""))
                    if len(held) == 4096:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    with batches_of(spark, 1):  # one archive at a time
        return materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS), "warc-records")


def archive(pages: DataFrame, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write all pages(page_id, url, html); returns the folder of the archives."""
    small_batches(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    keyed = plain.select("page_id", "url", payload.alias("payload"), F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"))
    marks = materialize(keyed.select("page_id", "payload_bytes", "digest", F.xxhash64("payload").alias("more")).where(F.col("payload_bytes") >= least), "warc-digests")
    # Equal bytes: both digests and the length agree.  Only digests that occur twice need the join.
    groups = marks.groupBy("digest", "more", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"), F.count_if(F.col("page_id").isNotNull()).alias("named")).where("copies > 1")
    groups = materialize(groups.where("named > 0").select("digest", "more", "payload_bytes", "last"), "warc-groups")
    # Few groups travel to the pages; many meet them in a join, which then moves the payloads once more.
    few = groups.count() <= SENT_GROUPS
    found = keyed.withColumn("more", F.xxhash64("payload")).join(F.broadcast(groups) if few else groups, ["digest", "more", "payload_bytes"], "left")
    # The payload of a revisit is dropped before it is dealt to archives.
    is_revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("last")))
    rows = found.select("page_id", "url", "payload_bytes", "digest", F.when(is_revisit, "revisit").otherwise("response").alias("kind"), F.when(is_revisit, F.col("last")).alias("refers_to"), F.when(~is_revisit, F.col("payload")).alias("payload"))
    return write_archives(rows, train_dictionary(plain), archive_bytes)
