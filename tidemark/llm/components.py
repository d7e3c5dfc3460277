"""Connected components of an edge table, by contraction: each task joins the nodes of its own edges, and only
the disagreements between tasks (edges between local roots) go to the next, much smaller level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK = 500_000  # edges that are joined at once in a task's memory


def _plain(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def local_roots(edges: DataFrame, kind: str) -> DataFrame:
    """``(node, root)``: every node of a chunk of edges with the least node that the chunk connects it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def joined() -> pa.RecordBatch:
            a = pa.chunked_array([b.column(0) for b in held]).to_pylist()
            b = pa.chunked_array([b.column(1) for b in held]).to_pylist()
            parent: dict = {}
            given: dict = {}
            for x, y in zip(a, b):
                px, py = _plain(x), _plain(y)
                given.setdefault(px, x)
                given.setdefault(py, y)
                for p in (px, py):
                    parent.setdefault(p, p)
                while parent[px] != px:
                    parent[px] = parent[parent[px]]
                    px = parent[px]
                while parent[py] != py:
                    parent[py] = parent[parent[py]]
                    py = parent[py]
                if px < py:
                    parent[py] = px
                elif py < px:
                    parent[px] = py
            nodes, roots = [], []
            for p, x in given.items():
                r = p
                while parent[r] != r:
                    parent[r] = parent[parent[r]]
                    r = parent[r]
                nodes.append(x)
                roots.append(given[r])
            t = held[0].schema.field(0).type
            return pa.RecordBatch.from_arrays([pa.array(nodes, t), pa.array(roots, t)], ["node", "root"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield joined()
                held, size = [], 0
        if size:
            yield joined()

    return edges.select("a", "b").mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """``(id, component)``: for every node of ``(a, b)`` the least node that it reaches.

    Direction, repeated edges, loops and rows with a null end do not matter; nodes may be integers, strings or
    structs of them. An empty edge table gives an empty result. Levels shrink at least by what tasks can join;
    none gathers a component.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = local_roots(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()), kind)
    pairs = cut(pairs)
    low = pairs.groupBy("node").agg(F.min("root").alias("m"), F.max("root").alias("_x"))
    between = cut(pairs.join(low.filter(F.col("m") != F.col("_x")).select("node", "m"), "node").filter(F.col("root") != F.col("m")).select(F.col("root").alias("a"), F.col("m").alias("b")).distinct())
    if between.isEmpty():
        return low.select(F.col("node").alias("id"), F.col("m").alias("component"))
    if not max_levels:
        raise RuntimeError("the components did not settle")
    upper = components(between, max_levels - 1).select(F.col("id").alias("m"), "component")
    return low.select("node", "m").join(upper, "m", "left").select(F.col("node").alias("id"), F.coalesce("component", "m").alias("component"))
