"""WARC archives in seekable Zstandard bundles: independent frames, a footer seek table, and an index of records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop, shared_folder, table, written

#: Magic numbers of the public seekable format: the skippable frame that holds the table, and the table's own end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
#: Frames that a task reads back, about, and tasks at most, beyond which each reads more.
FRAMES, TASKS = 64, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids of pages: this tag in 32 bits, 16 and 12 bits of the payload's digest around the version 4, then the page's
#: number in 64 bits.
TAG, VERSION = 0x70616765, 4
#: Names that Hadoop has for file systems, and the ones that Arrow has.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
#: Repeated payloads whose table is broadcast, at most (some 100 bytes each): beyond it, a salted join.
REPEATS, SALTS = 200_000, 64


Opened = Callable[[str], tuple[fs.FileSystem, str]]


def arrow_uri(path: str) -> str:
    """The path as Arrow writes it: its own schemes, and three slashes before a local path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return f"{SCHEMES.get(scheme, scheme)}:{'//' if rest.startswith('/') and not rest.startswith('//') else ''}{rest}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path of Hadoop's, and the path's name there. Credentials are those of Arrow's surroundings;
    where others are needed, writers and readers take another function like this one."""
    return fs.FileSystem.from_uri(arrow_uri(path))


class BundleWriter:
    """Appends records to one bundle; record() tells where each lies. close() writes the seek table."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = 3, opened: Opened = opened):
        system, name = opened(path)
        self.out, self.frame_bytes = system.open_output_stream(name, compression=None), frame_bytes
        self.zstd, self.table, self.held, self.at, self.bytes = zstandard.ZstdCompressor(level=level), [], [], 0, 0

    def record(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's plain bytes) of the record. A record is never cut; a large one has a frame to itself."""
        if self.held and self.at + len(data) > self.frame_bytes:
            self._flush()
        where = (len(self.table), self.at)
        self.held.append(data)
        self.at += len(data)
        return where

    def _flush(self) -> None:
        plain = b"".join(self.held)
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain)))
        self.held, self.at, self.bytes = [], 0, self.bytes + len(packed)

    def close(self) -> None:
        if self.held:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number: the footer is read first, then only the frames asked for."""

    def __init__(self, path: str, opened: Opened = opened):
        system, name = opened(path)
        self.file = system.open_input_file(name)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table at the end of {path}")
        width = 12 if flags & 0x80 else 8
        entries = self.file.read_at(count * width, end - 9 - count * width)
        sizes = [struct.unpack_from("<II", entries, k * width) for k in range(count)]
        starts = [0]
        for packed, _ in sizes:
            starts.append(starts[-1] + packed)
        self.frames, self.zstd = [(s, *x) for s, x in zip(starts, sizes)], zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        start, packed, plain = self.frames[number]
        return self.zstd.decompress(self.file.read_at(packed, start), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Of a page: its number and 28 bits of its payload's digest, so that pages of one number differ if their payloads do;
    rows alike in both are the same record. Of a page without a number: a name from its url and digest."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    bits = int.from_bytes(base64.b32decode(digest)[:4], "big") >> 4
    value = TAG << 96 | bits >> 12 << 80 | VERSION << 76 | (bits & 0xFFF) << 64 | page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str | None) -> int | None:
    """The number in a record id of a page; names from urls have another version."""
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 96 != TAG or value >> 76 & 0xF != VERSION:
        return None
    return int.from_bytes((value & ((1 << 64) - 1)).to_bytes(8, "big"), "big", signed=True)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the HTTP headers alone, so the full payload's length stays readable."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, None, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a place of a frame's plain bytes, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
    record = {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "payload_digest": digest, "payload_bytes": length, "refers_to": page_of(head.get("warc-refers-to")), "payload": payload}
    return record, end + 4 + len(block) + 4


def records(data: bytes) -> Iterator[tuple[int, dict]]:
    at = 0
    while at < len(data):
        record, after = parse(data, at)
        yield at, record
        at = after


INDEX = "page_id long, bundle string, frame int, offset int, length int"


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, opened: Opened = opened) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into bundles of the folder; returns the index of records.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id hold it (all of them, should
    the id repeat) and the others are revisits of it; rows without an id never are what others refer to, and in a group
    of such rows alone each is a response. A null html is an empty payload, a null url leaves its header out.

    A task streams its rows into bundles of its own names, and the index, which is written to a table before it is
    returned, names those of the attempts that counted: what a lost executor left half-written is never read, and
    remove_unnamed() clears it. The folder is made by Hadoop, where spark's own tables are; tasks write by Arrow.
    """
    spark = pages.sparkSession
    place, system = hadoop(spark, folder)
    system.mkdirs(place)
    folder = folder if ":" in folder.split("/")[0] else place.toString()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null")
    shared = written(shared.select("sha", "holder"), "warc-repeats")
    if shared.count() <= REPEATS:  # ids and digests alone are shuffled, payloads stay where they are read
        told = rows.join(F.broadcast(shared), "sha", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    told = told.select("page_id", "url", "payload", "sha", "holder")

    def run(batches):
        writer, path = None, ""
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(k, 256).to_pylist():
                    if writer is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(path, frame_bytes, opened=opened)
                    revisit = r["holder"] is not None and r["page_id"] != r["holder"]
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    data = warc_record(r["page_id"], r["url"], r["payload"], digest, r["holder"] if revisit else None, revisit)
                    out.append((r["page_id"], path, *writer.record(data), len(data)))
                    if writer.bytes >= bundle_bytes:
                        writer.close()
                        writer = None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return written(told.mapInArrow(run, INDEX), "warc-index")


def remove_unnamed(index: DataFrame, folder: str) -> int:
    """Removes the folder's bundles that the index doesn't name, as lost tasks leave them; returns how many. To be called
    once nothing writes there. What the driver holds is names, of which there is one for some BUNDLE_BYTES of archive."""
    place, system = hadoop(index.sparkSession, folder)
    if not system.exists(place):
        return 0
    named = {r.bundle.rsplit("/", 1)[1] for r in index.select("bundle").distinct().toLocalIterator()}
    found = [x.getPath() for x in system.listStatus(place)]
    gone = [x for x in found if x.getName().endswith(".warc.zst") and x.getName() not in named]
    for path in gone:
        system.delete(path, False)
    return len(gone)


def read_bundles(index: DataFrame, payload: bool = False, opened: Opened = opened) -> DataFrame:
    """Every record of the bundles that the index names, read frame by frame; each payload is held against its digest.

    Records come back as often as they were written: repeated pages, and those without an id, url or payload, too. An
    empty index gives an empty result.
    """
    frames = index.groupBy("bundle", "frame").agg(F.count("*").alias("n"), F.max("offset").alias("last"))
    # a row of the index is small, the frame it names isn't: partitions are told by number, not left to their bytes
    tasks = min(-(-frames.count() // FRAMES) or 1, TASKS)
    frames = frames.repartition(tasks, F.col("bundle"), (F.col("frame") / 16).cast("int")).sortWithinPartitions("bundle", "frame")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, bundle string, frame int, offset int" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "frame": pa.int32(), "offset": pa.int32(), "payload": pa.binary()}

    def run(batches):
        reader, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["bundle"]:
                    if reader:
                        reader.close()
                    reader, held = BundleReader(row["bundle"], opened), row["bundle"]
                found = [r | {"bundle": held, "frame": row["frame"], "offset": at} for at, r in records(reader.frame(row["frame"]))]
                if len(found) != row["n"] or found[-1]["offset"] != row["last"]:
                    raise ValueError(f"frame {row['frame']} of {held} doesn't hold what its index says")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kinds.get(c, pa.string())) for c in names], names)
        if reader:
            reader.close()

    return frames.mapInArrow(run, schema)


def read_record(bundle: str, frame: int, offset: int, opened: Opened = opened) -> dict:
    """One record by its place: the bundle's footer and one frame are all that is read."""
    reader = BundleReader(bundle, opened)
    try:
        return parse(reader.frame(frame), offset)[0]
    finally:
        reader.close()


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back: one row a page; where they lie is read_bundles' to tell."""
    index = write_bundles(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
