"""Remove what occurs earlier: every byte under a ``LENGTH``-byte string seen before.

Sparse suffix sorting over all texts:

1. Texts are packed into batches. In every window of ``LENGTH`` bytes the ``GRAM``
   bytes with the least hash are its anchor; the windows that share an anchor are its
   cell. Equal windows have equal anchors, so copies meet at anchors whose grams occur
   twice. Only hashes of grams are exchanged to find these.
2. The suffixes at those anchors (to the end of the cell, then what stands before the
   anchor, backwards) are sorted per task into runs, equal ones kept once, front-coded,
   and dealt by sampled splitters.
3. Each range merges its runs with a loser tree that carries the length of the prefix
   shared with the last output. Prefixes known to be equal are never compared again.
4. A suffix equal to the one before it repeats a whole cell. Suffixes that only share
   the gram are compared window by window, by a 64-bit hash within their group. Groups
   cut by a splitter send their windows on, under a 128-bit hash.

Equal suffixes are kept once per run, and splitters may cut anywhere, so neither a
passage in very many texts nor a gram with very many neighbours fills a task.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import BYTE, BASE, mix, power_size, powers
from .staging import Stage, tidied, with_row_key

LENGTH = 100
GRAM = 24
BATCH_BYTES = 4_000_000
SEGMENT = 1 << 19
RUN_ENTRIES = 100_000
PROBES = 16
SPLIT_SAMPLE = 20_000
OTHER_BASE = 0xD1342543DE82EF95
LAST = (1 << 63) - 1

SLICE = "part int, batch long, shared binary, sizes binary, tails binary, doc binary, row binary, source binary, at binary"
FOUND = "bucket int, batch long, first binary, second binary, doc binary, row binary, source binary, at binary"


def _batch_rows(rows: DataFrame) -> DataFrame:
    """Columns _row, _key, _text to batches: ids, keys, sizes, packed bytes, probes."""

    @tidied(powers)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        row, key, text, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            data = b"".join(text)
            at = np.random.default_rng(seq).integers(0, max(1, len(data)), PROBES)
            probes = [data[a : a + LENGTH] for a in at] if data else []
            columns = [
                pa.array([task << 32 | seq], pa.int64()),
                pa.array([row], pa.list_(pa.int64())),
                pa.array([key], pa.list_(pa.int64())),
                pa.array([[len(t) for t in text]], pa.list_(pa.int64())),
                pa.array([zstandard.compress(data, 3)], pa.binary()),
                pa.array([probes], pa.list_(pa.binary())),
            ]
            seq, held = seq + 1, 0
            row.clear(), key.clear(), text.clear()
            return pa.RecordBatch.from_arrays(columns, ["batch", "rows", "keys", "sizes", "data", "probes"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for r, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                t = t.as_py() or b""
                if row and held + len(t) > BATCH_BYTES:
                    yield flush()
                row.append(r), key.append(k), text.append(t)
                held += len(t)
        if row:
            yield flush()

    return rows.select("_row", "_key", "_text").mapInArrow(
        run, "batch long, rows array<long>, keys array<long>, sizes array<long>, data binary, probes array<binary>"
    )


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _window_hashes(flat: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on."""
    up, down = (p[: len(flat) + 1] for p in powers(power_size(len(flat)), base))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE[flat] * up[:-1], out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: len(flat) - width + 1]


def cells(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, last window) of every cell of the texts.

    ``flat`` is worked through in segments; a cell that a border cuts becomes two.
    """
    ends = np.cumsum(sizes)
    found = []
    width = LENGTH - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(0, len(flat) - LENGTH + 1), SEGMENT):
        part = flat[begin : begin + SEGMENT + LENGTH - 1]
        hashes = mix(_window_hashes(part, GRAM))
        n = len(part) - LENGTH + 1  # windows that begin here
        marked = np.full(-(-(n + width) // width) * width, np.uint64(2**64 - 1))
        marked[: len(hashes)] = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        rows = marked.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(rows, axis=1).ravel()
        least = np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])
        anchor = (least & low).astype(np.int64)
        # Windows that would reach into the next text do not exist.
        inside = np.zeros(n + 1, np.int32)
        stop = np.clip(ends - begin, 0, n)
        start = np.clip(ends - begin - LENGTH + 1, np.clip(ends - sizes - begin, 0, n), stop)
        np.add.at(inside, start, 1)
        np.add.at(inside, stop, -1)
        good = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        if not len(good):
            continue
        own = anchor[good]
        new = np.append(True, (own[1:] != own[:-1]) | (good[1:] != good[:-1] + 1))
        first = good[new]
        last = good[np.append(np.flatnonzero(new)[1:], len(good)) - 1]
        found.append((hashes[own[new]], own[new] + begin, first + begin, last + begin))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _grams(batches: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, grams): the distinct gram hashes of each batch."""

    @tidied(powers)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, sizes, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                gram = np.unique(cells(np.frombuffer(_unpack(data), np.uint8), np.array(sizes, np.int64))[0])
                bucket = (gram % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                packed = [gram[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([batch] * len(full), pa.int64()), pa.array(packed, pa.binary())],
                    ["bucket", "batch", "grams"],
                )

    return batches.select("batch", "sizes", "data").mapInArrow(run, "bucket int, batch long, grams binary")


def _shared(grams: DataFrame) -> DataFrame:
    """(batch, grams): those of its gram hashes that another batch has too."""

    @tidied(powers)
    def run(bucket: pa.Table) -> pa.Table:
        parts = [np.frombuffer(g, np.uint64) for g in bucket.column("grams").to_pylist()]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        gram = np.concatenate(parts)
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
        order = order[np.argsort(owner[order], kind="stable")]
        cuts = np.searchsorted(owner[order], np.arange(len(parts) + 1))
        packed = [gram[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table([bucket.column("batch"), pa.array(packed, pa.binary())], ["batch", "grams"])

    return grams.groupBy("bucket").applyInArrow(run, "batch long, grams binary")


def _spans(batch: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.lexsort((start, batch))
    batch, start, end = batch[order], start[order], end[order]
    cuts = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])) if len(batch) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(batch))):
        yield int(batch[a]), start[a:b].astype(np.int64).tobytes(), end[a:b].astype(np.int64).tobytes()


def _runs(batches: DataFrame, splitters: list[bytes], parts: int) -> DataFrame:
    """Front-coded slices of sorted runs per range, and repeats found within a run."""

    @tidied(powers)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        # doc, row, place and batch of each key
        facts = [array("q") for _ in range(4)]

        def flush() -> pa.RecordBatch:
            doc, row, at, source = (np.array(f, np.int64) for f in facts)
            order = np.lexsort((source, at, row, doc)).tolist()
            order.sort(key=held.__getitem__)
            keys = [held[k] for k in order]
            held.clear()
            for f in facts:
                del f[:]
            new = np.array([k == 0 or x != keys[k - 1] for k, x in enumerate(keys)], bool)
            order = np.array(order, np.int64)
            ends = at[order[~new]] + np.array([len(k) for k, n in zip(keys, new) if not n], np.int64) - 2
            spans = list(_spans(source[order[~new]], at[order[~new]], ends))
            keys = [k for k, n in zip(keys, new) if n]
            kept = [c[order[new]] for c in (doc, row, source, at)]
            out = []
            cuts = [0, *(bisect_left(keys, s) for s in splitters), len(keys)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b:
                    continue
                size = np.array([len(k) for k in keys[a:b]], np.uint8)
                width = int(size.max())
                grid = np.frombuffer(b"".join([k.ljust(width, b"\0") for k in keys[a:b]]), np.uint8).reshape(-1, width)
                equal = grid[1:] == grid[:-1]
                shared = np.where(equal.all(1), width, equal.argmin(1))
                shared = np.append(0, np.minimum(shared, np.minimum(size[1:], size[:-1]))).astype(np.uint8)
                tails = b"".join([k[n:] for k, n in zip(keys[a:b], shared.tolist())])
                columns = [c[a:b].tobytes() for c in kept]
                out.append((part, 0, shared.tobytes(), size.tobytes(), zstandard.compress(tails, 1), *columns))
            out += [(parts + batch % parts, batch, first, second, *(None,) * 5) for batch, first, second in spans]
            kinds = (pa.int32(), pa.int64(), *(pa.binary(),) * 7)
            columns = zip(*out) if out else [()] * 9
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SLICE.split(", ")]
            )

        for b in rows:
            for batch, keys, ids, sizes, packed, shared in zip(*(b.column(c).to_pylist() for c in range(6))):
                data, sizes = _unpack(packed), np.array(sizes, np.int64)
                gram, anchor, first, last = cells(np.frombuffer(data, np.uint8), sizes)
                values, counts = np.unique(gram, return_counts=True)
                wanted = np.concatenate([values[counts > 1], *(np.frombuffer(g, np.uint64) for g in shared or ())])
                pick = np.flatnonzero(np.isin(gram, wanted))
                owner = np.searchsorted(np.cumsum(sizes), first[pick], side="right").tolist()
                for o, m, a, z in zip(owner, anchor[pick].tolist(), first[pick].tolist(), last[pick].tolist()):
                    z += LENGTH
                    key = data[m:z] + data[a:m][::-1] + bytes((z - m, m - a))
                    held.append(key)
                    for f, x in zip(facts, (LAST if keys[o] is None else keys[o], ids[o], a, batch)):
                        f.append(x)
                    if len(held) >= RUN_ENTRIES:
                        yield flush()
        yield flush()

    return batches.select("batch", "keys", "rows", "sizes", "data", "shared").mapInArrow(run, SLICE)


def merge(runs: list[tuple[list[bytes], list[int], list[tuple]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (keys, prefix shared with the key before, tie order).

    Returns per output the run, the place in it, and the prefix shared with the output
    before. The tree holds losers; ``lcp[r]`` is what run r's key shares with the key
    that last beat it. Of two that share different lengths with the last output the one
    that shares more is smaller; only at equal lengths are bytes compared, from there.
    """
    count = len(runs)
    leaves = 1 << max(0, count - 1).bit_length()
    at = [0] * count
    key: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - count)
    lcp = [0] * leaves
    losers = [0] * max(1, leaves)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = key[a], key[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        n, m = lcp[a], lcp[b]
        if n != m:
            return (a, b) if n > m else (b, a)
        x, y = x[n:], y[n:]
        if x == y:
            first = runs[a][2][at[a]] < runs[b][2][at[b]]
            common = n + len(x)
        else:
            first = x < y
            k = min(len(x), len(y))
            differ = int.from_bytes(x[:k]) ^ int.from_bytes(y[:k])
            common = n + k - (differ.bit_length() + 7) // 8
        winner, loser = (a, b) if first else (b, a)
        lcp[loser] = common
        return winner, loser

    winners = [0] * (2 * leaves)
    winners[leaves:] = range(leaves)
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    out_run, out_at, out_lcp = [], [], []
    while key[top] is not None:
        here = at[top]
        out_run.append(top)
        out_at.append(here)
        out_lcp.append(lcp[top])
        at[top] = here = here + 1
        keys, shared, _ = runs[top]
        if here < len(keys):
            key[top], lcp[top] = keys[here], shared[here]
        else:
            key[top] = None
        node = (leaves + top) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1
    return out_run, out_at, out_lcp


def _repeated_windows(group: np.ndarray, window: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of windows that are not the first of their kind by ``order``."""
    by = np.lexsort((*order[::-1], window, group))
    later = (group[by][1:] == group[by][:-1]) & (window[by][1:] == window[by][:-1])
    return np.sort(by[1:][later])


def _windows(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, place in the cell, two hashes) of each window of the cells."""
    texts = [k[k[-2] : -2][::-1] + k[: k[-2]] for k in keys]
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    n = size - LENGTH + 1
    entry = np.repeat(np.arange(len(keys)), n)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + place
    return entry, place, mix(_window_hashes(flat, LENGTH)[at]), mix(_window_hashes(flat, LENGTH, OTHER_BASE)[at])


def _merged(slices: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Repeats found by merging each range, and windows of groups that it cuts."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.int32(), pa.int64(), *(pa.binary(),) * 6)

    @tidied(powers)
    def run(part: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if part.column("part")[0].as_py() >= parts:
            out = [(-1, b, f, s, *(None,) * 4) for b, f, s in zip(*(part.column(c).to_pylist() for c in ("batch", "shared", "sizes")))]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        runs, meta = [], []
        for s in part.select(["shared", "sizes", "tails", "doc", "row", "source", "at"]).to_pylist():
            shared, sizes, tails = list(s["shared"]), list(s["sizes"]), _unpack(s["tails"])
            keys, before, a = [], b"", 0
            for n, size in zip(shared, sizes):
                before = before[:n] + tails[a : a + size - n]
                a += size - n
                keys.append(before)
            doc, row, source, at = (np.frombuffer(s[c], np.int64) for c in ("doc", "row", "source", "at"))
            runs.append((keys, shared, list(zip(doc.tolist(), row.tolist(), at.tolist()))))
            meta.append((doc, row, source, at))
        out_run, out_at, out_lcp = merge(runs)
        base = np.cumsum([0, *(len(r[0]) for r in runs)])[:-1]
        which = base[out_run] + np.array(out_at)
        doc, row, source, at = (np.concatenate(c)[which] for c in zip(*meta))
        size = np.array([len(k) for r in runs for k in r[0]])[which]
        lcp = np.array(out_lcp)
        equal = np.append(False, (lcp[1:] == size[1:]) & (size[1:] == size[:-1]))
        out += [(-1, b, f, s, *(None,) * 4) for b, f, s in _spans(source[equal], at[equal], (at + size - 2)[equal])]

        keep = np.flatnonzero(~equal)
        group = np.cumsum(lcp[keep] < GRAM)
        cut = (group == group[0]) | (group == group[-1])
        counts = np.bincount(group)
        inner = np.flatnonzero(~cut & (counts[group] > 1))
        step = 5_000
        first = 0
        while first < len(inner):
            last = min(first + step, len(inner))
            while last < len(inner) and group[inner[last]] == group[inner[last - 1]]:
                last += 1
            some = keep[inner[first:last]]
            entry, place, window, _ = _windows([runs[out_run[k]][0][out_at[k]] for k in some])
            rank = np.empty(len(some), np.int64)
            rank[np.lexsort((at[some], row[some], doc[some]))] = np.arange(len(some))
            again = _repeated_windows(group[inner[first:last]][entry], window, rank[entry] * 256 + place)
            out += _window_spans(source[some], at[some], entry[again], place[again])
            first = last
        border = keep[cut]
        for first in range(0, len(border), step):
            some = border[first : first + step]
            entry, place, one, two = _windows([runs[out_run[k]][0][out_at[k]] for k in some])
            bucket = (one % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            whole = (one, two, doc[some][entry], row[some][entry], source[some][entry], at[some][entry] + place)
            for b in np.flatnonzero(np.diff(cuts)):
                o = order[cuts[b] : cuts[b + 1]]
                out.append((int(b), 0, *(w[o].tobytes() for w in whole)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names)

    return slices.groupBy("part").applyInArrow(run, FOUND)


def _window_spans(source: np.ndarray, at: np.ndarray, entry: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Repeated windows, sorted by entry and place, as spans of their batches."""
    new = np.append(True, (entry[1:] != entry[:-1]) | (place[1:] != place[:-1] + 1))[: len(entry)]
    last = np.append(np.flatnonzero(new)[1:], len(entry))[: new.sum()] - 1
    spans = _spans(source[entry[new]], at[entry[new]] + place[new], at[entry[last]] + place[last] + LENGTH)
    return [(-1, b, f, s, *(None,) * 4) for b, f, s in spans]


def _settled(cut: DataFrame) -> DataFrame:
    """Repeats among the windows of groups that splitters cut."""

    @tidied(powers)
    def run(bucket: pa.Table) -> pa.Table:
        columns = ("first", "second", "doc", "row", "source", "at")
        one, two, doc, row, source, at = (
            np.concatenate([np.frombuffer(b, k) for b in bucket.column(c).to_pylist()])
            for c, k in zip(columns, (np.uint64, np.uint64, *(np.int64,) * 4))
        )
        again = _repeated_windows(one, two, doc, row, at)
        spans = list(_spans(source[again], at[again], at[again] + LENGTH))
        batch, start, end = zip(*spans) if spans else ((), (), ())
        return pa.table([pa.array(batch, pa.int64()), pa.array(start, pa.binary()), pa.array(end, pa.binary())], ["batch", "first", "second"])

    return cut.groupBy("bucket").applyInArrow(run, "batch long, first binary, second binary")


def _applied(batches: DataFrame) -> DataFrame:
    """One row per text: what was removed, and the bytes that stay."""

    @tidied(powers)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for keys, ids, sizes, packed, firsts, seconds in zip(*(b.column(c).to_pylist() for c in range(6))):
                data = np.frombuffer(_unpack(packed), np.uint8)
                depth = np.zeros(len(data) + 1, np.int32)
                for first, second in zip(firsts or (), seconds or ()):
                    np.add.at(depth, np.frombuffer(first, np.int64), 1)
                    np.add.at(depth, np.frombuffer(second, np.int64), -1)
                gone = np.cumsum(depth[:-1]) > 0
                out, end = [], 0
                for size in sizes:
                    own = gone[end : end + size]
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(size > 0 and own[0])
                    out.append((size, int(np.count_nonzero(own)), spans, data[end : end + size][~own].tobytes()))
                    end += size
                size, removed, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(keys, pa.int64()),
                        *(pa.array(c, pa.int64()) for c in (size, removed, spans)),
                        pa.array(kept, pa.binary()),
                    ],
                    ["_row", "_key", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return batches.select("keys", "rows", "sizes", "data", "firsts", "seconds").mapInArrow(
        run, "_row long, _key long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, _key, n_bytes, n_removed, n_spans, kept), one row per row of ``df``.

    A byte goes if a ``LENGTH``-byte string that covers it also begins earlier: in a
    text with a smaller ``key``, or in the same text. Null keys come last; rows with
    equal keys, repeated rows too, are in the order of ``_row``, which follows the
    partitions of ``df``. If ``df`` has a column ``_row`` of distinct longs it is used, else made. Null is
    the empty text. Texts are bytes in UTF-8 and strings never cross texts; ``kept`` may
    therefore end within a character. ``n_spans`` counts maximal removed stretches.
    """
    spark = df.sparkSession
    stage = Stage(spark, "repeats")
    rows = df if "_row" in df.columns else with_row_key(df, "_row")
    rows = rows.select("_row", F.col(key).cast("long").alias("_key"), F.encode(F.col(text), "utf-8").alias("_text"))
    batches = stage.keep(_batch_rows(rows), "batches")
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    probes = batches.select(F.explode("probes").alias("probe")).orderBy(F.xxhash64("probe"), "probe").limit(SPLIT_SAMPLE)
    sample = sorted({bytes(r.probe) for r in probes.collect()})
    splitters = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    shared = _shared(_grams(batches, parts)).groupBy("batch").agg(F.collect_list("grams").alias("shared"))
    slices = _runs(batches.drop("probes").join(shared, "batch", "left"), splitters, parts)
    found = stage.keep(_merged(slices, parts, parts), "found")
    spans = found.filter("bucket < 0").select("batch", "first", "second").union(_settled(found.filter("bucket >= 0")))
    spans = spans.groupBy("batch").agg(
        F.collect_list(F.struct("first", "second")).alias("spans"),
    )
    spans = spans.select("batch", F.col("spans.first").alias("firsts"), F.col("spans.second").alias("seconds"))
    return _applied(batches.drop("probes").join(spans, "batch", "left"))
