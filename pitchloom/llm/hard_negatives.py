"""Hard negatives by exact integer inner products, scored with the Four-Russians method.

1. Components become ``floor(scale * x)``. Rows are numbered in the order of their key,
   sorted by label and packed into blocks. A block of candidates holds bit planes: plane
   p has, per row and group of eight dimensions, one byte with bit p of the eight
   components in two's complement.
2. For a few anchors at a time a table gives the sum of every subset of the components
   of each group. A score is the sum over planes of 2**p times the looked-up sums of
   the plane's bytes; the highest plane counts negative. That is the whole inner product.
3. Anchor blocks meet the candidate blocks that share a label with them: the best of
   each block are merged to an anchor's positives. Then they meet all blocks: each
   block yields, per anchor and positive, its best rows of other labels inside the
   positive's bounds, and the best of those are kept.

A pair of blocks is one group of bounded size, dealt by both block numbers, so no label
or anchor gathers in one task. Blocks are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage

#: Rows of a block of candidates and of anchors, and the least to cut small tables into.
BLOCK_ROWS = 32_768
ANCHOR_ROWS = 8_192
LEAST_ROWS = 1_024
#: Anchors whose tables are built together, and candidates scored together.
TOGETHER = 64
CHUNK = 1_024
#: Scaled components must stay below this, so that scores stay below 2**63.
LARGEST = 1 << 24
LONGEST = 1 << 13


def bit_planes(v: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of integers in two's complement, the sign last."""
    n, dim = v.shape
    bits = max(int(np.abs(v).max(initial=0)).bit_length(), 1) + 1
    padded = np.zeros((n, -(-dim // 8) * 8), v.dtype)
    padded[:, :dim] = v
    return np.stack([np.packbits((padded >> p & 1).astype(bool), axis=1, bitorder="little").T for p in range(bits)])


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): the sums of all subsets of each group of eight dimensions."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((groups * 8, n), dtype)
    padded[:dim] = anchors.T
    tables = np.zeros((groups, 256, n), dtype)
    for g in range(groups):
        for bit in range(8):
            np.add(tables[g, : 1 << bit], padded[8 * g + bit], out=tables[g, 1 << bit : 2 << bit])
    return tables


def scores(anchors: np.ndarray, planes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First anchor and (anchors, rows) of exact inner products, some anchors at a time."""
    bits, groups, rows = planes.shape
    largest = int(np.abs(anchors).sum(axis=1).max(initial=0)) << bits
    dtype = np.int32 if largest < 1 << 31 else np.int64
    for first in range(0, len(anchors), TOGETHER):
        tables = subset_sums(anchors[first : first + TOGETHER], dtype)
        groups_here = min(groups, len(tables))  # further components of either side meet zeros
        out = np.zeros((rows, tables.shape[2]), dtype)
        for at in range(0, rows, CHUNK):
            total = out[at : at + CHUNK]
            looked, summed = np.empty_like(total), np.empty_like(total)
            # From the sign down: doubling what is there shifts each plane by its place.
            for p in reversed(range(bits)):
                summed[:] = 0
                for g in range(groups_here):
                    np.take(tables[g], planes[p, g, at : at + CHUNK], axis=0, out=looked, mode="clip")
                    np.add(summed, looked, out=summed)
                np.add(total, total, out=total)
                (np.subtract if p == bits - 1 else np.add)(total, summed, out=total)
        yield first, out.T


def _blocks(rows: DataFrame, size: int, planes: bool) -> DataFrame:
    """(block, low, high, rows, labels, values, shape): rows packed as they come.

    ``low`` and ``high`` are the least and greatest label number. Blocks never cross partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield packed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield packed(pa.Table.from_batches(held))

    def packed(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("v").combine_chunks()
        lengths = np.asarray(lists.value_lengths())
        flat = np.asarray(lists.flatten())
        dim = int(lengths.max(initial=0))
        v = np.zeros((len(t), dim), np.int64)
        v[np.repeat(np.arange(len(t)), lengths), np.concatenate([np.arange(k) for k in lengths])] = flat
        values = bit_planes(v) if planes else v
        labels = np.asarray(t.column("label"))
        return pa.RecordBatch.from_pylist(
            [
                {
                    "low": int(labels.min()),
                    "high": int(labels.max()),
                    "rows": np.asarray(t.column("row")).astype("<i8").tobytes(),
                    "labels": labels.astype("<i8").tobytes(),
                    "values": np.ascontiguousarray(values).tobytes(),
                    "shape": list(values.shape),
                }
            ],
            schema,
        )

    schema = pa.schema(
        [("low", pa.int64()), ("high", pa.int64()), ("rows", pa.binary()), ("labels", pa.binary()), ("values", pa.binary()), ("shape", pa.list_(pa.int64()))]
    )
    return rows.select("row", "label", "v").mapInArrow(run, "low long, high long, rows binary, labels binary, values binary, shape array<long>")


def _numbered(blocks: DataFrame, stage: Stage, name: str) -> tuple[DataFrame, int]:
    """Stored blocks with numbers from 0, and how many there are."""
    blocks = stage.keep(blocks.withColumn("id", F.monotonically_increasing_id()), name, "uncompressed")
    blocks = blocks.withColumn("part", F.shiftright("id", 33))
    sizes = blocks.groupBy("part").agg(F.count("*").alias("n"))
    # A row per partition of the table: a partition's blocks follow those before it.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    number = (F.col("before") + F.col("id") % F.lit(1 << 33)).alias("block")
    out = blocks.join(F.broadcast(before), "part")
    return out.select(number, "low", "high", "rows", "labels", "values", "shape"), blocks.count()


def _row(t: pa.Table, name: str):
    return t.column(name)[0].as_py()


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(_row(t, name), "<i8")


def _best(anchor_labels: np.ndarray, anchor_rows: np.ndarray, labels: np.ndarray, rows: np.ndarray, s: np.ndarray, k: int):
    """Per anchor its first ``k`` rows of the same label, itself left out."""
    for a in range(len(anchor_rows)):
        at = np.flatnonzero((labels == anchor_labels[a]) & (rows != anchor_rows[a]))
        mine = s[a, at]
        if len(at) > k:
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            at, mine = at[mine >= least], mine[mine >= least]
        order = np.lexsort((rows[at], -mine))[:k]
        yield a, rows[at[order]], mine[order]


def _within(anchor_label: int, labels: np.ndarray, rows: np.ndarray, s: np.ndarray, goals: np.ndarray, k: int, low: int, high: int):
    """Per goal (a positive's score) the first ``k`` rows of other labels inside its bounds."""
    # Python's integers: a bound times a score may pass 64 bits.
    least, most = min(-(-low * g // 100) for g in goals), max(high * g // 100 for g in goals)
    at = np.flatnonzero((s >= least) & (s <= most) & (labels != anchor_label))
    if not len(at):
        return
    at = at[np.lexsort((rows[at], -s[at]))]
    falling = -s[at].astype(np.int64)
    for n, g in enumerate(goals):
        first = np.searchsorted(falling, -(high * g // 100))
        end = min(first + k, np.searchsorted(falling, -(-(-low * g // 100)), "right"))
        if first < end:
            yield n, rows[at[first:end]], s[at[first:end]]


def mine(
    df: DataFrame,
    anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that meet ``anchor``. Each has up to ``positives`` positives:
    the other rows of its label with the highest scores. For each of them the
    ``negatives`` highest rows of other labels follow whose score is between ``low`` and
    ``high`` percent of the positive's. Ties go by key. Without positives, or without rows
    inside the bounds, nothing is returned.

    Rows with a null key, label or vector, or with a null or non-finite component, take no
    part, nor do those with a component of 65,536 or more at scale 256 (``LARGEST``) or over
    8,192 components. Components that a shorter vector lacks count as 0, an empty vector
    scores 0 with all. Rows with equal keys are rows of their own, in the order read; an
    anchor never is its own positive, but its copy may be. Other columns are ignored, an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    stage = Stage(spark, "negatives")
    value = F.transform(F.col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST))) & (F.size(value) <= LONGEST)
    rows = df.select(
        F.col(key).alias("key"), F.col(label).alias("name"), value.alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), sound.alias("sound")
    ).filter("key is not null AND name is not null AND sound")
    # Numbers follow the key: they break ties and tell rows with equal keys apart.
    rows = rows.withColumn("read", F.monotonically_increasing_id()).orderBy("key", "read")
    whole = F.transform("x", lambda x: F.floor(x))
    rows = stage.keep(rows.select(F.monotonically_increasing_id().alias("row"), "key", "name", whole.alias("v"), "is_anchor"), "rows")
    # Labels of any type, compared as hashes; equal hashes of different labels are not expected.
    rows = rows.withColumn("label", F.xxhash64("name"))
    total = rows.count()
    cores = spark.sparkContext.defaultParallelism
    size = min(block_rows, max(min(LEAST_ROWS, block_rows), -(-total // (2 * cores))))
    parts = max(1, -(-total // (4 * size)))
    candidates, n = _numbered(_blocks(rows.repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row"), size, True), stage, "candidates")
    anchors = rows.filter("is_anchor")
    parts = max(1, -(-anchors.count() // (4 * anchor_rows)))
    asked, m = _numbered(_blocks(anchors.repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row"), anchor_rows, False), stage, "anchors")
    # Each pair of blocks is a group; all pairs are as many as the work is.
    tasks = max(1, min(n * m, max(2 * cores, n * m // 16)))

    def pairs(blocks: DataFrame, own: str, other: str, count: int) -> DataFrame:
        out = blocks.withColumnRenamed("block", own)
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count, 1) - 1).cast("long"))))

    def grouped(blocks: DataFrame):
        # Named anew, as both sides of a cogroup may come from one table.
        return blocks.select(*(F.col(c).alias(c) for c in blocks.columns)).repartition(tasks, "c", "a").groupBy("c", "a")

    ranges = candidates.select(F.col("block").alias("c"), F.col("low").alias("c_low"), F.col("high").alias("c_high"))
    meets = pairs(ranges, "c", "a", m).join(asked.select(F.col("block").alias("a"), "low", "high"), "a")
    # The pairs that share a label; both sides are dealt by the pair.
    meets = meets.filter("low <= c_high AND c_low <= high").select("c", "a")

    def best(_, c: pa.Table, a: pa.Table) -> pa.Table:
        out = [[], [], []]
        for a_rows, a_labels, _, labels, rows, s in _met(c, a):
            for k, found, points in _best(a_labels, a_rows, labels, rows, s, positives):
                out[0].append(np.full(len(found), a_rows[k]))
                out[1].append(found)
                out[2].append(points)
        return _table(("anchor", "positive", "score"), out)

    left = meets.join(candidates.withColumnRenamed("block", "c"), "c")
    right = meets.join(asked.withColumnRenamed("block", "a"), "a")
    firsts = grouped(left).cogroup(grouped(right)).applyInArrow(best, "anchor long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    firsts = firsts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    firsts = stage.keep(firsts, "positives")

    goals = firsts.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("goals"))
    goals = _goals(asked, goals, stage)

    def within(_, c: pa.Table, a: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        for a_rows, a_labels, a_goals, labels, rows, s in _met(c, a):
            for k in range(len(a_rows)):
                if not a_goals[k]:
                    continue
                for place, found, points in _within(a_labels[k], labels, rows, s[k], a_goals[k], negatives, low, high):
                    out[0].append(np.full(len(found), a_rows[k]))
                    out[1].append(np.full(len(found), place + 1))
                    out[2].append(found)
                    out[3].append(points)
        return _table(("anchor", "place", "negative", "negative_score"), out)

    every = grouped(pairs(candidates, "c", "a", m)).cogroup(grouped(pairs(goals, "a", "c", n)))
    hard = every.applyInArrow(within, "anchor long, place long, negative long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = hard.join(firsts.withColumn("place", F.col("place").cast("long")), ["anchor", "place"])
    for name in ("anchor", "positive", "negative"):
        names = rows.select(F.col("row").alias(name), F.col("key").alias(f"{name}_id"))
        out = out.join(names, name)
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


def _goals(asked: DataFrame, goals: DataFrame, stage: Stage) -> DataFrame:
    """Anchor blocks with the positives' scores of their anchors, in the order of the rows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), block)), pa.array(np.arange(len(rows))), pa.array(rows)], ["block", "at", "anchor"]
                )

    places = asked.select("block", "rows").mapInArrow(listed, "block long, at long, anchor long")
    found = places.join(goals, "anchor").groupBy("block").agg(
        F.collect_list(F.struct("at", F.transform("goals", lambda g: g["score"]).alias("scores"))).alias("goals")
    )
    return stage.keep(asked.join(found, "block"), "asked", "uncompressed")


def _met(c: pa.Table, a: pa.Table) -> Iterator[tuple]:
    """What a pair of blocks holds, and the scores of some anchors at a time."""
    if not len(c) or not len(a):
        return
    planes = np.frombuffer(_row(c, "values"), np.uint8).reshape(_row(c, "shape"))
    values = _ints(a, "values").reshape(_row(a, "shape"))
    a_rows, a_labels = _ints(a, "rows"), _ints(a, "labels")
    goals: list[list[int]] = [[] for _ in a_rows]
    if "goals" in a.column_names:
        for g in _row(a, "goals"):
            goals[g["at"]] = g["scores"]
    rows, labels = _ints(c, "rows"), _ints(c, "labels")
    for first, s in scores(values, planes):
        some = slice(first, first + len(s))
        yield a_rows[some], a_labels[some], goals[some], labels, rows, s


def _table(names: tuple[str, ...], columns: list[list[np.ndarray]]) -> pa.Table:
    whole = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in columns]
    return pa.table(dict(zip(names, whole)))
