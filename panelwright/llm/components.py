"""Connected components of an edge table by alternating star contraction.

Each round rehangs neighbours onto the smallest node they see (first the larger
neighbours, then the smaller ones); before the rounds every partition contracts
its own edges.  Minima are partially aggregated and joined back, so that a node
with very many neighbours is split by the skew handling of the join instead of
meeting in one task.  Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._storage import materialize


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition; yields (node, smallest node of its part)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([find(x) for x in part], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` (long, not null) to ``node, root``: every node that has an edge to another, with the smallest node it is connected to.

    Self-loops and repeated edges change nothing; without edges the result is empty.
    """
    e = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"), "stars")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
        if tuple(now) == state or not now["n"]:
            break
        state = tuple(now)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = materialize(hung.where("a <> b").distinct(), "stars")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
