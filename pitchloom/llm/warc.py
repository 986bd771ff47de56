"""WARC records in seekable Zstandard bundles, written and read by Spark.

Records are gathered into frames of about ``FRAME_BYTES``, each compressed on its own,
and frames into bundles of about ``BUNDLE_BYTES``. A bundle ends in a skippable frame
with the seek table (the sizes of all frames before and after compression), so any
Zstandard reader can unpack it whole and one that knows the table can jump. A bundle is
one row of a table, written with Spark's own commit, together with its index: per
record its id, frame, offset within the unpacked frame, and length.

Of records with equal payloads of at least ``LEAST_SHARED`` bytes that with the
smallest id holds the payload; the others are revisits that point to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
LEAST_SHARED = 100
# Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
URN = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = (
    "bundle long, archive binary, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"
)
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to string, payload binary, intact boolean, bundle long, frame int, offset long, length long"
)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer frame: (compressed, unpacked) size of every frame before it."""
    entries = b"".join(struct.pack("<II", a, b) for a, b in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frame_places(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, unpacked size) of every frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable archive")
    places, start = [], 0
    entries = archive[-9 - 8 * count : -9]
    for a, b in struct.iter_unpack("<II", entries):
        places.append((start, a, b))
        start += a
    return places


def record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of ``RECORDS`` up to ``intact``."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:] if line)
    size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    refers_to = fields.get("WARC-Refers-To")
    payload, intact = None, True
    if refers_to is None:
        payload = block[cut:]
        found = hashlib.sha256(payload).hexdigest()
        intact, digest = found == digest and len(payload) == size, found
    strip = lambda v: v and v[1:-1]
    return (
        strip(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"],
        size, digest, strip(refers_to), payload, intact,
    )


def _bundles(rows: DataFrame) -> DataFrame:
    """Columns record_id, uri, payload, digest, refers_to to bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=3).compress
        open_: list[bytes] = []
        held = packed = 0
        done: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        index: list[tuple[str, int, int, int]] = []

        def close_frame() -> None:
            nonlocal held, packed
            done.append(compress(b"".join(open_)))
            sizes.append((len(done[-1]), held))
            packed += len(done[-1])
            open_.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, packed
            if open_:
                close_frame()
            archive = b"".join([*done, seek_table(sizes)])
            ids, frames, offsets, lengths = zip(*index)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | seq], pa.int64()),
                    pa.array([archive], pa.binary()),
                    pa.array([ids], pa.list_(pa.string())),
                    pa.array([frames], pa.list_(pa.int32())),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                ],
                ["bundle", "archive", "record_ids", "frames", "offsets", "lengths"],
            )
            seq, packed = seq + 1, 0
            done.clear(), sizes.clear(), index.clear()
            return out

        for batch in batches:
            ids, uris, payloads, digests, refers = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                data = record(
                    ids[k].as_py(), uris[k].as_py(), payloads[k].as_py() or b"", digests[k].as_py(), refers[k].as_py()
                )
                index.append((ids[k].as_py(), len(sizes), held, len(data)))
                open_.append(data)
                held += len(data)
                if held >= FRAME_BYTES:
                    close_frame()
                    if packed >= BUNDLE_BYTES:
                        yield flush()
        if index:
            yield flush()

    return rows.select("_id", "_uri", "_payload", "_digest", "_refers").mapInArrow(run, BUNDLES)


def _urn(c: str) -> Column:
    """Ids as URNs; null is a URN of its own."""
    return F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit("null")))


def write(df: DataFrame, stage: Stage, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one record per row of ``df``; the table of bundles.

    Null payloads are empty, null URLs an empty target. The smallest id (nulls last) of
    equal payloads gets the response; rows that repeat this id with the payload are
    responses too. Other columns are not written.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    digest, size = F.sha2(F.encode(text, "utf-8"), 256), F.octet_length(text)
    # Only payloads that occur twice are looked up; usually a small table, whose size
    # Spark knows once it is written.
    light = df.select(F.col(key).alias("_first"), digest.alias("_digest"), size.alias("_size"))
    firsts = (
        light.filter(F.col("_size") >= LEAST_SHARED)
        .groupBy("_digest")
        .agg(F.min("_first").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    firsts = stage.keep(firsts, "firsts")
    rows = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(url), F.lit("")).alias("_uri"),
        F.encode(text, "utf-8").alias("_payload"),
        digest.alias("_digest"),
    ).join(firsts.withColumn("_shared", F.lit(True)), "_digest", "left")
    again = F.col("_shared") & ~F.col("_key").eqNullSafe(F.col("_first"))
    rows = rows.select(
        _urn("_key").alias("_id"), "_uri", "_payload", "_digest", F.when(again, _urn("_first")).alias("_refers")
    )
    return stage.keep(_bundles(rows), "bundles", "uncompressed")


def read(bundles: DataFrame) -> DataFrame:
    """All records that the index of each row names, one row each.

    Only frames that hold one of them are unpacked. ``intact`` tells whether a payload
    has the length and digest that its record states; the digest given is that found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for bundle, archive, frames, offsets, lengths in zip(
                *(batch.column(c).to_pylist() for c in ("bundle", "archive", "frames", "offsets", "lengths"))
            ):
                places, at, data, out = frame_places(archive), -1, b"", []
                for frame, offset, length in sorted(zip(frames, offsets, lengths)):
                    if frame != at:
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                            out = []
                        start, size, full = places[frame]
                        at, data = frame, unpack(archive[start : start + size], max_output_size=full)
                    out.append((*parse(data[offset : offset + length]), bundle, frame, offset, length))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return bundles.select("bundle", "archive", "frames", "offsets", "lengths").mapInArrow(run, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ids are in the column ``record_id`` of ``wanted``.

    Ids meet the index first, so archives are touched only where a record is wanted.
    """
    index = bundles.select("bundle", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r"))
    hits = (
        index.select("bundle", "r.*")
        .join(wanted.select(F.col("record_id").alias("record_ids")).distinct(), "record_ids", "left_semi")
        .groupBy("bundle")
        .agg(*(F.collect_list(c).alias(c) for c in ("frames", "offsets", "lengths")))
    )
    return read(bundles.select("bundle", "archive").join(hits, "bundle"))


def key_of(urn: Column) -> Column:
    """The id in a URN, null where it was null."""
    name = F.substring(urn, len(URN) + 1, 1 << 30)
    return F.when(name != "null", name).cast("long")
