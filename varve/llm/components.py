"""Connected components of links that may be too many for one machine.

Up to ``FEW`` links, a checked number, one task merges them in a table of roots: rounds of shuffles would
cost more than the work. Beyond that, large-star and small-star turns do it with bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.session import remove, stash


#: Links that one task merges at most: 16 bytes each.
FEW = 250_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], ["id", "component"])


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the node's smallest neighbour (or itself)."""
    both = _sides(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component) of every id in links (a, b) that has a link to another; component: the smallest id reachable.

    Large-star and small-star turns until the links no longer change; every turn is written to the shared
    folder, so a lost executor costs one turn. A hub is no hot task: minima are taken before the exchange.
    """
    if links.limit(few + 1).count() <= few:
        return links.where("a != b").select("a", "b").coalesce(1).mapInArrow(_merge, "id long, component long")
    tidy = lambda e: e.where("a != b").distinct()
    edges, path = stash(tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    seen = None
    while True:
        new, new_path = stash(tidy(_small(tidy(_large(edges)))), "links")
        remove(links.sparkSession, path)
        edges, path = new, new_path
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
