"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


class Forest:
    """Union-find over integers; the smallest of each set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        """Each node that is not a root, with its root."""
        children = [x for x, p in self.parent.items() if x != p]
        return children, [self.find(x) for x in children]


def contract(links: DataFrame) -> DataFrame:
    """(child, parent): the links of each partition, each node with its smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.link(a, b)
        child, parent = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], ["child", "parent"])

    return links.mapInArrow(run, "child long, parent long")


def connected(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, component): every node that has links, and the smallest it can reach.

    ``links`` has two long columns without nulls; links to oneself and repeated ones do no harm, an
    empty table gives an empty one. Each round brings the links of a node together,
    keeps one per node and sends it on to the parent's parent, so chains halve. A node
    with very many links is first reduced to one per partition.
    """
    links = contract(links)
    rounds = 0
    while True:
        links = stage.keep(contract(links.repartition("child")), f"{name}-{rounds}")
        rounds += 1
        up = links.select(F.col("child").alias("parent"), F.col("parent").alias("above")).distinct()
        jumped = links.join(up, "parent", "left")
        moved = jumped.select(F.count("above").alias("moved"), F.count("*").alias("n")).first()
        nodes = links.select("child").distinct().count()
        if moved.moved == 0 and moved.n == nodes:
            break
        links = links.union(jumped.filter("above is not null").select("child", "above"))
    roots = links.select(F.col("parent").alias("node")).distinct()
    return links.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
