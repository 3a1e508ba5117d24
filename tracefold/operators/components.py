"""Connected components without neighbour lists or pair joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.session import cut_lineage, drop_stage

#: Edges a task contracts at once.
FOREST_EDGES = 400_000


def star_edges(members: DataFrame, key: list[str], node: str = "id", center: DataFrame | None = None) -> DataFrame:
    """Edges from each member of a key to the key's smallest member (or to its row in ``center``).

    All members of a key belong together, so n-1 edges connect them; a key shared by a third of all
    rows yields that many edges, not their square. The minimum is partially aggregated before the shuffle.
    """
    if center is None:
        # Most keys have one member; leaving them out keeps the join's inner side small.
        low, high = F.min(node).alias("_center"), F.max(node).alias("_last")
        center = members.groupBy(*key).agg(low, high).where(F.col("_center") != F.col("_last")).drop("_last")
    joined = members.join(center, key)
    return joined.where(F.col(node) != F.col("_center")).select(F.col(node).alias("src"), F.col("_center").alias("dst"))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    held, types = 0, None

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def take() -> Iterator[pa.RecordBatch]:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        for i in range(0, len(pairs), 20_000):
            some = pairs[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in some], types[c]) for c in (0, 1)], names=["src", "dst"])

    for batch in batches:
        types = [batch.schema.field(c).type for c in ("src", "dst")]
        for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= FOREST_EDGES:
            yield from take()
            held = 0
    if parent:
        yield from take()


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (src, smaller dst) with the components of each task's edges, a bounded number of edges at a time."""
    rows = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    return rows.mapInArrow(_forests, rows.schema)


def _ordered(edges: DataFrame) -> DataFrame:
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.select(high.alias("src"), low.alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node with an edge: (node, component).

    Tasks first contract their own edges to stars. Large-star / small-star rounds follow: each is two grouped
    minima and two joins over an edge list that never exceeds its initial size, and the list converges to one
    star per component in a logarithmic number of rounds. Each round is a Parquet stage that replaces the one
    before; only a count and a hash reach the driver.
    """
    current = cut_lineage(contracted(edges).distinct(), "components")
    before = _fingerprint(current)
    for _ in range(max_rounds if before[0] else 0):
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").where(F.col("dst") > F.col("src")).select(
            F.col("dst").alias("src"), F.col("low").alias("dst")
        )
        large = _ordered(large)
        nearest = large.groupBy("src").agg(F.min("dst").alias("low"))
        moved = large.join(nearest, "src")
        small = moved.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            moved.select("src", F.col("low").alias("dst"))
        )
        last, current = current, cut_lineage(_ordered(small), "components")
        after = _fingerprint(current)
        drop_stage(last)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def component_of(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Every node with its component; nodes without edges stand alone."""
    return joined_components(nodes, connected_components(edges), node)


def joined_components(nodes: DataFrame, components: DataFrame, node: str = "id") -> DataFrame:
    found = components.withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn("component", F.coalesce("component", F.col(node)))
