"""Round trips, the seek table, and records fetched by id."""

import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from pitchloom.llm import warc
from pitchloom.llm.staging import Stage

LONG = "é" * 60
ROWS = [
    (5, "http://a/ü b", LONG), (3, None, LONG), (9, "http://c", LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None),
    (6, "u", ""), (7, "u", "x" * 300_000), (8, "u", "WARC/1.1\r\n\r\n" * 20), (3, "again", LONG), (None, "n", LONG), (None, "n", "z" * 150),
    (10, "u", "a" * 99), (11, "u", "a" * 99), (12, "u", "b" * 100), (13, "u", "b" * 100),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        first = min(ids) if ids and len(data) >= 100 and sum((h or "").encode() == data for _, _, h in rows) > 1 else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(records):
    return sorted(
        [(warc_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc_id(r.refers_to)) for r in records], key=repr
    )


def warc_id(urn):
    return None if urn in (None, "urn:page:null") else int(urn.removeprefix(warc.URN))


def test_round_trip(spark, monkeypatch):
    for frame, bundle in ((1 << 20, 8 << 20), (200, 300)):
        monkeypatch.setattr(warc, "FRAME_BYTES", frame)
        monkeypatch.setattr(warc, "BUNDLE_BYTES", bundle)
        bundles = warc.write(table(spark).repartition(2), Stage(spark, "test"))
        records = warc.read(bundles).collect()
        assert got(records) == want(ROWS)
        assert all(r.intact for r in records)
        full = {(r.record_id, r.payload_digest): bytes(r.payload) for r in records if r.record_type == "response"}
        for i, _, html in ROWS:
            data = (html or "").encode()
            digest = hashlib.sha256(data).hexdigest()
            if (f"{warc.URN}{i if i is not None else 'null'}", digest) in full:
                assert full[f"{warc.URN}{i if i is not None else 'null'}", digest] == data


def test_any_reader_can_unpack_and_the_table_can_seek(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    for b in warc.write(table(spark).coalesce(1), Stage(spark, "test")).collect():
        archive = bytes(b.archive)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(archive), read_across_frames=True).read()
        places = warc.frame_places(archive)
        frames = [zstandard.ZstdDecompressor().decompress(archive[s : s + n]) for s, n, _ in places]
        assert b"".join(frames) == whole and [len(f) for f in frames] == [n for _, _, n in places]
        assert len(frames) > 3
        for urn, k, offset, length in zip(b.record_ids, b.frames, b.offsets, b.lengths):
            assert f"<{urn}>".encode() in frames[k][offset : offset + length]
            assert frames[k][offset : offset + length].startswith(b"WARC/1.1\r\n")


def test_fetch_by_id(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    bundles = warc.write(table(spark).repartition(3), Stage(spark, "test"))
    ids = spark.createDataFrame([("urn:page:7",), ("urn:page:3",), ("urn:page:3",), ("urn:page:999",)], "record_id string")
    assert sorted(r.record_id for r in warc.fetch(bundles, ids).collect()) == ["urn:page:3", "urn:page:3", "urn:page:7"]


def test_damage_is_seen_and_empty_tables(spark):
    empty = table(spark).filter(F.lit(False))
    assert warc.read(warc.write(empty, Stage(spark, "test"))).count() == 0
    data = warc.record("urn:page:1", "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse(data)[-1] is True and warc.parse(data.replace(b"abc\r\n", b"abd\r\n"))[-1] is False
