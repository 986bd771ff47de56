"""Groups of texts whose word n-grams overlap, by a prefix-filtered similarity join.

1. Texts are packed into batches. Texts with equal sets of n-grams are one node.
2. Each batch sends the hashes of its n-grams once; those of several batches come back
   with the order of magnitude of how many. So every batch knows which n-grams are
   repeated at all.
3. Rare-first prefix filter: n-grams are ordered by how often they occur, single ones
   first, ties by hash. Two sets that are similar enough share one of their first
   ``n - ceil(t * n) + 1``. Of these only repeated ones are exchanged.
4. Nodes that meet under an n-gram and pass the length filter are chained, and the
   chains' components are clusters: no link can leave a cluster.
5. Each cluster is joined on its own by rare-first prefixes, with length, positional
   and suffix filters, and each remaining pair is verified once, exactly, unless it is
   in one component already. A cluster beyond ``TASK_GRAMS`` is dealt to blocks, and
   every pair of blocks is a task; so no task holds more than two blocks.

Sets are of 64-bit hashes and a node's id is a 64-bit hash of its set, so up to some
billions of distinct texts no two are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .shingles import powers, shingle_sets
from .staging import Stage, tidied, with_row_key

TASK_GRAMS = 2_000_000
BATCH_BYTES = 4_000_000
FLUSH = 300_000
COLUMNS = ("gram", "node", "size")
KINDS = (np.uint64, np.int64, np.int32)


def least_overlap(a, b, percent: int):
    """Fewest shared n-grams of two sets of these sizes that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n, percent: int):
    return n + (-percent * n // 100) + 1


def node_of(grams: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams))))) if len(grams) else None


def _unpack(packed: bytes, sizes: list[int]) -> list[bytes]:
    data, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def batches_of(rows: DataFrame, n: int) -> DataFrame:
    """Columns _row, _key, _text to batches: rows, keys, nodes, n-grams, packed texts."""

    @tidied(powers)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        row, key, text, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            sets = shingle_sets(text, n)
            columns = [
                pa.array([task << 32 | seq], pa.int64()),
                pa.array([row], pa.list_(pa.int64())),
                pa.array([key], pa.list_(pa.int64())),
                pa.array([[node_of(s) for s in sets]], pa.list_(pa.int64())),
                pa.array([[len(s) for s in sets]], pa.list_(pa.int64())),
                pa.array([[len(t) for t in text]], pa.list_(pa.int64())),
                pa.array([zstandard.compress(b"".join(text), 3)], pa.binary()),
            ]
            seq, held = seq + 1, 0
            row.clear(), key.clear(), text.clear()
            return pa.RecordBatch.from_arrays(columns, ["batch", "rows", "keys", "nodes", "grams", "sizes", "data"])

        for batch in batches:
            for r, k, t in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2).cast(pa.binary())):
                t = t.as_py() or b""
                if row and held + len(t) > BATCH_BYTES:
                    yield flush()
                row.append(r), key.append(k), text.append(t)
                held += len(t)
        if row:
            yield flush()

    return rows.select("_row", "_key", "_text").mapInArrow(
        run,
        "batch long, rows array<long>, keys array<long>, nodes array<long>, grams array<long>, sizes array<long>, data binary",
    )


def _deal(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, packed columns) for the buckets of ``keys`` that are not empty."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[b] : cuts[b + 1]]
        yield b, [c[some].tobytes() for c in columns]


def _rest(grams: np.ndarray, buckets: int) -> np.ndarray:
    """What, besides the bucket, is kept of a hash to tell repeated n-grams."""
    return (grams // np.uint64(buckets)).astype(np.uint32)


def repeated(batches: DataFrame, n: int, buckets: int) -> DataFrame:
    """(batch, shared): per bucket how often each n-gram of the batch occurs elsewhere.

    A batch sends its distinct n-grams in order and gets one small number for each, in
    the same order: 0 if it is the only one to have it, else the order of magnitude of how
    many have. Hashes are cut to the bucket and 32 bits here; two that fall together count as
    repeated wherever they are, which costs a little work and loses nothing.
    """

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, sizes, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                grams = np.unique(np.concatenate(shingle_sets(_unpack(data, sizes), n)))
                dealt = list(_deal(grams, buckets, _rest(grams, buckets)))
                bucket, packed = zip(*dealt) if dealt else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket, pa.int32()),
                        pa.array([batch] * len(bucket), pa.int64()),
                        pa.array([p[0] for p in packed], pa.binary()),
                    ],
                    ["bucket", "batch", "rest"],
                )

    def answer(bucket: pa.Table) -> pa.Table:
        parts = [np.frombuffer(g, np.uint32) for g in bucket.column("rest").to_pylist()]
        _, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = np.ceil(np.log2(count)).astype(np.uint8)[place]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        packed = [zstandard.compress(p.tobytes(), 1) for p in np.split(often, cuts)]
        return pa.table([bucket.column("bucket"), bucket.column("batch"), pa.array(packed, pa.binary())], ["bucket", "batch", "often"])

    sent = batches.select("batch", "sizes", "data").mapInArrow(send, "bucket int, batch long, rest binary")
    back = sent.groupBy("bucket").applyInArrow(answer, "bucket int, batch long, often binary")
    return back.groupBy("batch").agg(F.collect_list(F.struct("bucket", "often")).alias("shared"))


def prefixes(batches: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """The repeated n-grams among the first of each node, packed per bucket.

    A node that has any is also a row of its own, with bucket -1, its batch and its text:
    only these can be in a pair, so the other texts need not travel again.
    """

    @tidied(powers)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in COLUMNS]
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            whole = [np.concatenate(h) if h else np.zeros(0, k) for h, k in zip(held, KINDS)]
            dealt = list(_deal(whole[0], buckets, *whole))
            for h in held:
                h.clear()
            total = 0
            packed = [pa.array([p[c] for _, p in dealt], pa.binary()) for c in range(len(COLUMNS))]
            return rows_of([b for b, _ in dealt], packed, [None] * len(dealt), None, [None] * len(dealt))

        def rows_of(bucket: list, packed: list, node: list, batch: int | None, text: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket, pa.int32()),
                    *packed,
                    pa.array([batch] * len(bucket), pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(text, pa.binary()),
                ],
                ["bucket", *COLUMNS, "batch", "_node", "_text"],
            )

        for b in rows:
            for batch, nodes, sizes, data, shared in zip(*(b.column(c).to_pylist() for c in range(5))):
                texts, own_text = _unpack(data, sizes), {}
                sets = shingle_sets(texts, n)
                # How often an n-gram occurs: 0 once, 1 in this batch alone, else 1 more
                # than the logarithm of the number of batches.
                own, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                bucket = (own % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                level = (count > 1).astype(np.int64)
                for s in shared or ():
                    often = np.frombuffer(zstandard.decompress(s["often"]), np.uint8)
                    place = order[cuts[s["bucket"]] : cuts[s["bucket"] + 1]]
                    level[place] = np.where(often > 0, often + np.int64(1), level[place])
                level = level[back]
                seen, end = set(), 0
                for node, grams, text in zip(nodes, sets, texts):
                    grade, end = level[end : end + len(grams)], end + len(grams)
                    if node is None or node in seen:  # a copy adds nothing
                        continue
                    seen.add(node)
                    first = np.lexsort((grams, grade))[: prefix(len(grams), percent)]
                    first = grams[first[grade[first] > 0]]
                    if len(first):
                        own_text[node] = text
                    for h, v in zip(held, (first, np.full(len(first), node), np.full(len(first), len(grams), np.int32))):
                        h.append(v)
                    total += len(first)
                gaps = [pa.nulls(len(own_text), pa.binary()) for _ in COLUMNS]
                yield rows_of([-1] * len(own_text), gaps, list(own_text), batch, list(own_text.values()))
                if total >= FLUSH:
                    yield flush()
        yield flush()

    packed = ", ".join(f"{c} binary" for c in COLUMNS)
    return batches.select("batch", "nodes", "sizes", "data", "shared").mapInArrow(
        run, f"bucket int, {packed}, batch long, _node long, _text binary"
    )


def chains(packed: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that meet under an n-gram and may be long enough."""

    @tidied(powers)
    def run(bucket: pa.Table) -> pa.Table:
        gram, node, size = (
            np.concatenate([np.frombuffer(b, k) for b in bucket.column(c).to_pylist()]) for c, k in zip(COLUMNS, KINDS)
        )
        order = np.lexsort((node, size, gram))
        gram, node, size = gram[order], node[order], size[order].astype(np.int64)
        # In order of size, a gap too large for two neighbours is too large for all.
        near = (gram[1:] == gram[:-1]) & (node[1:] != node[:-1]) & (100 * size[:-1] >= percent * size[1:])
        k = np.flatnonzero(near)
        forest = Forest()
        for a, b in zip(node[k].tolist(), node[k + 1].tolist()):
            forest.link(a, b)
        child, parent = forest.edges()
        return pa.table([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], ["child", "parent"])

    entries = packed.filter("bucket >= 0").select("bucket", *COLUMNS)
    return entries.groupBy("bucket").applyInArrow(run, "child long, parent long")


def _may_overlap(a: np.ndarray, b: np.ndarray, least: int, depth: int = 2) -> bool:
    """Suffix filter: cut both sorted sets at the middle value of one and bound the overlap."""

    def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if not depth or not len(a) or not len(b):
            return min(len(a), len(b))
        m = len(a) // 2
        k = int(np.searchsorted(b, a[m]))
        return bound(a[:m], b[:k], depth - 1) + bound(a[m:], b[k:], depth - 1)

    return bound(a, b, depth) >= least


def join_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets, as few as needed.

    ``side`` 0 and 1: only pairs across the two; all equal: all pairs. Sets are taken
    by size, each looked up among those before it.
    """
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(ranks, minlength=len(values))
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, often))] = np.arange(len(values))
    ranked = [np.sort(r) for r in np.split(place[ranks], np.cumsum([len(s) for s in sets])[:-1])]
    across, forest, links = len(np.unique(side)) > 1, Forest(), []
    index: dict[int, list[tuple[int, int]]] = {}
    for x in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        own, n = ranked[x], len(ranked[x])
        # Per candidate: n-grams met so far, and the last place of one in either set.
        met: dict[int, int] = {}
        for at, gram in enumerate(own[: prefix(n, percent)].tolist()):
            for y, before in index.get(gram, ()):
                size = len(ranked[y])
                if 100 * size < percent * n or met.get(y, 0) < 0 or (across and side[x] == side[y]):
                    continue
                seen = met.get(y, 0) + 1
                # Positional filter: what is left behind this place in both sets.
                enough = seen + min(n - at - 1, size - before - 1) >= least_overlap(n, size, percent)
                met[y] = seen if enough else -1
        found = sorted((y for y, seen in met.items() if seen > 0), key=lambda y: -met[y])
        for y in found:
            if forest.find(x) == forest.find(y):
                continue
            least = least_overlap(n, len(ranked[y]), percent)
            if not _may_overlap(own, ranked[y], least):
                continue
            k = np.searchsorted(own, ranked[y])
            shared = int((own[np.minimum(k, n - 1)] == ranked[y]).sum())
            if shared >= least:
                forest.link(x, y)
                links.append((x, y))
        for at, gram in enumerate(own[: prefix(n, percent)].tolist()):
            index.setdefault(gram, []).append((x, at))
    return links


def verified(tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """Links found in each task."""

    @tidied(powers)
    def run(task: pa.Table) -> pa.Table:
        rows = task.select(["_cluster", "_i", "_j", "_block", "_node"]).to_pandas()
        sets = shingle_sets(task.column("_text").to_pylist(), n)
        found: list[tuple[int, int]] = []
        node, block = rows["_node"].to_numpy(), rows["_block"].to_numpy()
        for (_, i, j), at in rows.groupby(["_cluster", "_i", "_j"]).indices.items():
            side = block[at] if i != j else np.zeros(len(at), int)
            found += [(int(node[at[a]]), int(node[at[b]])) for a, b in join_sets([sets[k] for k in at], side, percent)]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["child", "parent"])

    return tasks.groupBy("_task").applyInArrow(run, "child long, parent long")


def components(rows: DataFrame, n: int, percent: int, stage: Stage) -> DataFrame:
    """(_row, _key, n_shingles, component_id, _group) from columns _row, _key and _text."""
    buckets = max(64, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    batches = stage.keep(batches_of(rows, n), "batches")
    names = {"rows": "_row", "keys": "_key", "nodes": "_node", "grams": "n_shingles"}
    places = batches.select("batch", F.explode(F.arrays_zip(*names)).alias("r"))
    places = places.select("batch", *(F.col(f"r.{c}").alias(to) for c, to in names.items()))
    full = places.filter("_node is not null")
    known = batches.join(repeated(batches, n, buckets), "batch", "left")
    packed = stage.keep(prefixes(known, n, percent, buckets), "prefixes")
    clusters = connected(chains(packed, percent), stage, "clusters")

    classes = full.groupBy("_node").agg(
        F.min("_key").alias("_first"), F.min("batch").alias("batch"), F.min("n_shingles").alias("_size")
    )
    classes = stage.keep(classes, "classes")
    members = clusters.withColumnRenamed("node", "_node").join(classes, "_node")
    members = stage.keep(members.select("batch", "_node", F.col("component").alias("_cluster"), "_size"), "members")
    sizes = members.groupBy("_cluster").agg(F.ceil(F.sum("_size") / TASK_GRAMS).alias("_blocks"))
    total = members.agg(F.sum("_size")).first()[0] or 0
    bins = 2 * (total // TASK_GRAMS) + 8
    asked = (
        members.join(sizes, "_cluster")
        .withColumn("_block", F.pmod(F.xxhash64("_node"), "_blocks"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
        .withColumn(
            "_task",
            F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("_cluster"), F.lit(bins))).otherwise(
                F.xxhash64("_cluster", "_i", "_j")
            ),
        )
        .select("batch", "_node", "_task", "_cluster", "_i", "_j", "_block")
    )
    texts = packed.filter("bucket < 0").select("batch", "_node", "_text")
    tasks = texts.join(asked, ["batch", "_node"])
    links = connected(verified(tasks, n, percent), stage, "links").withColumnRenamed("node", "_node")
    smallest = links.join(classes, "_node").groupBy("component").agg(F.min("_first").alias("_least"))
    linked = links.join(smallest, "component").select("_node", F.col("component").alias("_root"), "_least")
    labels = classes.join(linked, "_node", "left").select(
        "_node",
        F.when(F.col("_root").isNotNull(), F.col("_least")).otherwise(F.col("_first")).alias("component_id"),
        F.coalesce("_root", "_node").alias("_group"),
    )
    found = full.select("_row", "_key", "n_shingles", "_node").join(labels, "_node").drop("_node")
    apart = places.filter("_node is null").select("_row", "_key", "n_shingles", F.col("_key").alias("component_id"), F.lit(None).cast("long").alias("_group"))
    return found.unionByName(apart)


def similar(
    df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", stage: Stage | None = None
) -> DataFrame:
    """(_row, _key, n_shingles, component_id, _group), one row per row of ``df``.

    Two rows link when the Jaccard similarity of their sets of ``n``-word n-grams is
    at least ``percent`` / 100; the component is the smallest ``key`` that links reach.
    Words are cut at the six ASCII white-space characters, A-Z lower-cased. Texts
    without words, and null, have 0 n-grams and link with nothing. Null keys count as
    no id: they take the component of their group, null if it has no other. Repeated
    rows link with each other. ``_group`` tells groups apart whatever their ids, null without words. A column ``_row`` of distinct longs is used as row key; else one is made.
    ``stage`` is where intermediate tables go, for callers that drop them.
    """
    stage = stage or Stage(df.sparkSession, "ngrams")
    if "_row" not in df.columns:
        df = with_row_key(df, "_row")
    rows = df.select("_row", F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return components(rows, n, percent, stage)
