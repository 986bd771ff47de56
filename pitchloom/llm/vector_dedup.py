"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors are one node. Vectors that are null, empty, zero or hold null or
   non-finite components take no part.
2. Nodes are dealt to shards by hash; a shard holds about ``SHARD_ROWS`` at most. Each
   gets a graph of layers: a layer holds one in ``THIN`` of the nodes below it, and a
   search descends from the top. Neighbours are picked for variety: one that is nearer
   to a neighbour already picked than to the node itself is left to the end.
3. Every block of nodes meets every shard. The beam starts ``BEAM`` wide and is widened
   for a node as long as all it holds are links. For each shard the beam is first
   audited: probes at the threshold's distance from stored vectors, and stored vectors
   themselves, are compared with brute force, and the beam doubles until ``RECALL`` of
   the pairs are found (as wide as the shard it is exact).
4. Pairs found are verified by their cosine in double precision; links are counted per
   node and shard, contracted to a forest in the task, and joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .staging import Stage

SHARD_ROWS = 50_000
LEAST_SHARDS = 6
BLOCK_ROWS = 8_000
NEIGHBOURS = 16
BUILD_BEAM = 40
BEAM = 32
THIN = 16
RECALL = 0.98
PROBES = 200
GROUP = 500


class Graph:
    """A layered graph over the rows of ``x``, which have length 1."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None, beam: int = BEAM) -> None:
        self.x = x
        self.beam = beam
        # Layer k holds the first n / THIN**k rows.
        self.sizes = [len(x)]
        while self.sizes[-1] > 4 * NEIGHBOURS:
            self.sizes.append(-(-self.sizes[-1] // THIN))
        if links is not None:
            self.links = links
            return
        self.links = [np.zeros((0, 0), np.int32) for _ in self.sizes]
        for layer in reversed(range(len(self.sizes))):
            self._grow(layer)

    def _pick(self, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``2 * NEIGHBOURS`` of each row's candidates (-1: none), the varied first."""
        width = 2 * NEIGHBOURS
        out = np.full((len(own), width), -1, np.int32)
        for a in range(0, len(own), GROUP):
            some, cand = own[a : a + GROUP], candidates[a : a + GROUP]
            sims = np.einsum("qcd,qd->qc", self.x[cand], self.x[some])
            sims[(cand < 0) | (cand == some[:, None])] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            twice = np.zeros(cand.shape, bool)
            # The same candidate twice stands side by side, having one similarity.
            twice[:, 1:] = cand[:, 1:] == cand[:, :-1]
            sims[twice] = -np.inf
            among = np.matmul(self.x[cand], self.x[cand].transpose(0, 2, 1))
            picked = np.zeros(cand.shape, bool)
            for c in range(cand.shape[1]):
                near = np.where(picked, among[:, c, :], -np.inf).max(1)
                picked[:, c] = (sims[:, c] > near) & np.isfinite(sims[:, c]) & (picked.sum(1) < width)
            rank = np.where(picked, 0, 1) + np.where(np.isfinite(sims), 0, 2)
            best = np.argsort(rank, axis=1, kind="stable")[:, :width]
            chosen = np.take_along_axis(cand, best, 1)
            chosen[np.take_along_axis(rank, best, 1) > 1] = -1
            out[a : a + GROUP, : chosen.shape[1]] = chosen
        return out

    def _grow(self, layer: int) -> None:
        """Insert the rows of a layer in batches that double what is there."""
        n, width = self.sizes[layer], 2 * NEIGHBOURS
        links = self.links[layer] = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            new = np.arange(done, min(n, max(4 * NEIGHBOURS, 2 * done)))
            k = min(BUILD_BEAM, len(new))
            found = []
            for a in range(0, len(new), GROUP):
                some = new[a : a + GROUP]
                beside = self.x[some] @ self.x[new].T
                cand = new[np.argpartition(-beside, k - 1, axis=1)[:, :k]].astype(np.int32)
                if done:
                    start = self._descend(self.x[some], layer + 1, done)
                    old, _ = self._beam(self.x[some], layer, start, BUILD_BEAM)
                    cand = np.hstack([old, cand])
                found.append(cand)
            links[new] = self._pick(new, np.vstack(found))
            # The neighbours' own lists take the new rows in, and are picked anew.
            a, b = np.repeat(new, width), links[new].ravel()
            ok = b >= 0
            a, b = a[ok], b[ok]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            targets, first, count = np.unique(b, return_index=True, return_counts=True)
            place = np.arange(len(b)) - np.repeat(first, count)
            extra = np.full((len(targets), min(width, int(count.max(initial=1)))), -1, np.int32)
            fits = place < extra.shape[1]
            extra[np.repeat(np.arange(len(targets)), count)[fits], place[fits]] = a[fits]
            links[targets] = self._pick(targets, np.hstack([links[targets], extra]))
            done = int(new[-1]) + 1

    def _descend(self, q: np.ndarray, down_to: int, limit: int) -> np.ndarray:
        """A start for each query in the layer below ``down_to``."""
        at = np.zeros(len(q), np.int32)
        for layer in range(len(self.sizes) - 1, down_to - 1, -1):
            if self.sizes[layer] <= limit:
                ids, _ = self._beam(q, layer, at, 4)
                at = ids[:, 0]
        return at

    def _beam(self, q: np.ndarray, layer: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once; (ids, similarities), best first."""
        links, x, count = self.links[layer], self.x, len(q)
        rows = np.arange(count)
        ids = np.full((count, beam), -1, np.int32)
        sims = np.full((count, beam), -np.inf, np.float32)
        todo = np.zeros((count, beam), bool)
        seen = np.zeros((count, len(links) + 1), bool)  # the last column takes the gaps
        ids[:, 0], sims[:, 0], todo[:, 0] = start, np.einsum("qd,qd->q", x[start], q), True
        seen[rows, start] = True
        active = rows
        wide = min(4, beam)
        while len(active):
            own = np.where(todo[active], sims[active], -np.inf)
            pick = np.argpartition(-own, wide - 1, axis=1)[:, :wide] if wide < beam else np.tile(np.arange(beam), (len(active), 1))
            live = np.take_along_axis(own, pick, 1) > -np.inf
            going = live.any(1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            flags = todo[active]
            np.put_along_axis(flags, pick, False, 1)
            todo[active] = flags
            near = np.where(live[:, :, None], links[np.take_along_axis(ids[active], pick, 1)], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[active[:, None], near] & (near >= 0)
            seen[active[:, None], near] = True
            seen[:, -1] = False
            far = np.einsum("qmd,qd->qm", x[near], q[active])
            far[~fresh] = -np.inf
            all_sims = np.hstack([sims[active], far])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(np.hstack([ids[active], near]), best, 1)
            todo[active] = np.take_along_axis(np.hstack([todo[active], fresh]), best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        beam = min(beam, len(self.x))
        ids, sims = [], []
        for a in range(0, len(q), GROUP):
            some = q[a : a + GROUP]
            i, s = self._beam(some, 0, self._descend(some, 1, len(self.x)), beam)
            ids.append(i), sims.append(s)
        return np.vstack(ids), np.vstack(sims)

    def within(self, q: np.ndarray, least: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs found with at least this similarity, in single precision."""
        beam, rows, out = beam or self.beam, np.arange(len(q)), []
        while len(rows):
            ids, sims = self.search(q[rows], beam)
            # A beam full of links may hide more of them behind.
            full = (sims[:, -1] >= least) & (beam < len(self.x))
            hit = (sims >= least) & ~full[:, None]
            at, place = np.nonzero(hit)
            out.append((rows[at], ids[at, place]))
            rows, beam = rows[full], 4 * beam
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 2

    def audit(self, least: float, wanted: float = RECALL) -> float:
        """Double the beam until probes find the share ``wanted`` of what brute force does."""
        rng = np.random.default_rng(len(self.x))
        own = self.x[rng.integers(0, len(self.x), PROBES)]
        aside = rng.normal(size=own.shape)
        aside -= (aside * own).sum(1, keepdims=True) * own
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        edge = min(1.0, least + 0.002)
        probes = np.vstack([own, edge * own + np.sqrt(1 - edge * edge) * aside]).astype(np.float32)
        want = set(zip(*(c.tolist() for c in np.nonzero(probes @ self.x.T >= least))))
        while True:
            got = set(zip(*(c.tolist() for c in self.within(probes, least))))
            recall = len(got & want) / max(1, len(want))
            if recall >= wanted or self.beam >= len(self.x):
                return recall
            self.beam *= 2


PACKED = "dim int, shard int, nodes binary, weights binary, raw binary"


def _packed(rows: DataFrame, by: str) -> DataFrame:
    """Nodes of one dimension and shard (or block) as one row of packed arrays."""

    def run(group: pa.Table) -> pa.Table:
        raw = np.array(group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32)
        order = np.argsort(group.column("node").to_numpy())
        raw = raw.reshape(len(order), -1)[order]
        node, n = group.column("node").to_numpy()[order], group.column("n").to_numpy()[order]
        return pa.table(
            [
                pa.array([raw.shape[1]], pa.int32()),
                group.column("shard")[:1].cast(pa.int32()),
                *(pa.array([v.tobytes()], pa.binary()) for v in (node, n, raw)),
            ],
            ["dim", "shard", "nodes", "weights", "raw"],
        )

    return rows.withColumnRenamed(by, "shard").groupBy("dim", "shard").applyInArrow(run, PACKED)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so none overflows."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def build(shards: DataFrame, least: float) -> DataFrame:
    """Add the graph of each shard, its audited beam and the recall the audit saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _unit(np.frombuffer(row["raw"], np.float32).reshape(-1, row["dim"])).astype(np.float32)
                graph = Graph(x)
                recall = graph.audit(least)
                columns = [pa.array([row[c]], k) for c, k in zip(("dim", "shard", "nodes", "weights", "raw"), (pa.int32(), pa.int32(), *(pa.binary(),) * 3))]
                columns += [
                    pa.array([[t.tobytes() for t in graph.links]], pa.list_(pa.binary())),
                    pa.array([graph.beam], pa.int32()),
                    pa.array([recall], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "shard", "nodes", "weights", "raw", "links", "beam", "recall"])

    return shards.mapInArrow(run, f"{PACKED}, links array<binary>, beam int, recall double")


def search(pairs: DataFrame, least: float) -> DataFrame:
    """Per block and shard: (node, n) link counts, and (child, parent) forests as n null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["raw"], np.float32).reshape(-1, row["dim"])
                x = _unit(raw)
                graph = Graph(x.astype(np.float32), [np.frombuffer(t, np.int32).reshape(-1, 2 * NEIGHBOURS) for t in row["links"]], row["beam"])
                node, weight = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
                own = np.frombuffer(row["own_nodes"], np.int64)
                q = _unit(np.frombuffer(row["own_raw"], np.float32).reshape(-1, row["dim"]))
                at, to = graph.within(q.astype(np.float32), least - 1e-4)
                ok = own[at] != node[to]
                at, to = at[ok], to[ok]
                exact = np.concatenate([np.einsum("pd,pd->p", q[at[a : a + 50_000]], x[to[a : a + 50_000]]) for a in range(0, max(1, len(at)), 50_000)])
                at, to = at[exact >= least], to[exact >= least]
                counts = np.bincount(at, weight[to], len(own)).astype(np.int64)
                forest = Forest()
                for a, b in zip(own[at].tolist(), node[to].tolist()):
                    forest.link(a, b)
                child, parent = forest.edges()
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own[some], np.array(child, np.int64)]), pa.int64()),
                        pa.array([None] * len(some) + parent, pa.int64()),
                        pa.array(counts[some].tolist() + [None] * len(child), pa.int64()),
                    ],
                    ["child", "parent", "n"],
                )

    return pairs.mapInArrow(run, "child long, parent long, n long")


def link_vectors(
    df: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Add ``n_links``, ``component_id`` and ``kept`` to every row.

    Rows link when the cosine of their vectors is at least ``least``; equal vectors do.
    ``n_links`` counts the other rows linked directly, the component is the smallest
    ``key`` reachable, and the row that has it is kept. Vectors that take no part, see
    the module, have no links and are kept. Vectors of different length do not
    link. Null keys take the component of their group; without another id it is null
    and the row kept. Repeated rows link with each other. Columns of these names are replaced.
    """
    spark = df.sparkSession
    stage = Stage(spark, "vectors")
    made = ("n_links", "component_id", "kept")
    shown = [c for c in df.columns if c not in made]
    value = F.col(vector).cast("array<float>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    node = F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.transform(value, lambda v: v + F.lit(0.0).cast("float"))))
    rows = df.select(*shown, node.alias("_node"), value.alias("_vector"))
    classes = (
        rows.filter("_node is not null")
        .groupBy(F.col("_node").alias("node"))
        .agg(F.count("*").alias("n"), F.min(key).alias("first"), F.any_value("_vector").alias("vector"))
    )
    classes = stage.keep(classes.withColumn("dim", F.size("vector")), "classes")
    total = classes.count()
    shards = max(LEAST_SHARDS, -(-total // shard_rows))
    blocks = max(1, -(-total // BLOCK_ROWS))
    light = classes.select("node", "n", "vector", "dim")
    graphs = _packed(light.withColumn("_shard", F.pmod(F.xxhash64("node"), F.lit(shards))), "_shard")
    # A graph is work for one task, and a shard may be alone in its partition.
    graphs = stage.keep(build(graphs.repartition(shards, "dim", "shard"), least), "graphs", "uncompressed")
    asked = _packed(light.withColumn("_block", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(blocks))), "_block")
    asked = asked.select("dim", F.col("shard").alias("block"), F.col("nodes").alias("own_nodes"), F.col("raw").alias("own_raw"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = asked.join(graphs, ["dim", "shard"])
    pairs = pairs.repartition(blocks * shards, "dim", "block", "shard")
    found = stage.keep(search(pairs, least), "found")
    links = found.filter("parent is not null").select("child", "parent")
    parts = connected(links, stage, "links")
    direct = found.filter("n is not null").groupBy(F.col("child").alias("node")).agg(F.sum("n").alias("_direct"))
    smallest = parts.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("_least"))
    labels = (
        classes.select("node", "n", "first")
        .join(parts, "node", "left")
        .join(smallest, "component", "left")
        .join(direct, "node", "left")
        .select(
            F.col("node").alias("_node"),
            (F.col("n") - 1 + F.coalesce("_direct", F.lit(0))).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("_least")).alias("component_id"),
        )
    )
    out = rows.select(*shown, "_node").filter("_node is not null").join(labels, "_node").drop("_node")
    apart = rows.filter("_node is null").select(*shown, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    return out.unionByName(apart).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
