"""Set-overlap links: ids that share at least two items of one scope.

Listing the pairs of an id's items costs the square of its set, listing the pairs of an item's ids the square of that list,
and either may be long. Only components matter here, so what is linked anyway is never looked at again:

1. items with one holder go; what is left is joined to the components known from elsewhere;
2. neighbouring items of a set, rarest first, are keys: sets that are equal or nearly so meet in as many rows as they have
   items;
3. items all of whose holders are in one component go, and sets with fewer than two items left go with them;
4. of what remains, two sets of different components share either an item with few holders, and meet in that item's list,
   or only items with many holders. Those meet by pairs of such items or, where a set has more pairs than its items have
   holders, by counting what it shares with all holders. Each set takes the cheaper way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.components import connected_components, star_edges
from tracefold.session import cut_lineage, drop_stage

#: Holders up to which an item's ids are paired.
FEW = 48


def _held_apart(entries: DataFrame, scope: list[str], by: str) -> DataFrame:
    """Entries of items whose holders differ in ``by``, with the item's number of holders, in sets of two or more of them."""
    items = entries.groupBy(*scope, "item").agg(F.min(by).alias("_low"), F.max(by).alias("_high"), F.count(F.lit(1)).alias("holders"))
    kept = entries.join(items.where(F.col("_low") != F.col("_high")).select(*scope, "item", "holders"), [*scope, "item"])
    sets = kept.groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).drop("_n")
    return kept.join(sets, [*scope, "id"])


def overlap_components(entries: DataFrame, scope: list[str], known: DataFrame, node: str = "id") -> DataFrame:
    """Components (node, component) of the ``known`` edges and of all overlaps of two items.

    ``entries`` (``scope`` columns, id, item) must be distinct. Where ids are known to belong together, the column ``node``
    tells what an id belongs to; edges and components are over nodes then, of which there may be far fewer.
    """
    entries = entries.select(*scope, "id", "item", F.col(node).alias("_node"))
    shared = cut_lineage(_held_apart(entries, scope, "_node"), "overlap-shared")
    nearby = Window.partitionBy(*scope, "id").orderBy("holders", "item")
    keyed = shared.withColumn("before", F.lag("item").over(nearby)).where(F.col("before").isNotNull()).select(*scope, "before", "item", "_node")
    near = star_edges(keyed if node == "id" else keyed.distinct(), [*scope, "before", "item"], node="_node")
    components = connected_components(known.unionByName(near))

    placed = shared.drop("holders").join(components.withColumnRenamed("node", "_node"), "_node", "left")
    placed = placed.withColumn("component", F.coalesce("component", F.col("_node")))
    apart = cut_lineage(_held_apart(placed, scope, "component"), "overlap-apart")
    drop_stage(shared)
    if apart.isEmpty():
        return components
    links = cut_lineage(_rare_links(apart, scope).unionByName(_common_links(apart, scope)).distinct(), "overlap-links")
    stars = components.where(F.col("node") != F.col("component")).select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return connected_components(stars.unionByName(links))


def _side(rows: DataFrame, suffix: str, scope: list[str], keep: list[str]) -> DataFrame:
    return rows.select(*scope, *[F.col(c).alias(c + suffix) if c != "item" else F.col(c) for c in keep])


def _between(met: DataFrame) -> DataFrame:
    return met.select(F.col("component_a").alias("src"), F.col("component_b").alias("dst"))


def _rare_links(apart: DataFrame, scope: list[str]) -> DataFrame:
    """Components of sets that share an item with few holders."""
    keep, pair = ["item", "id", "component"], [*scope, "id_a", "id_b", "component_a", "component_b"]
    few, many = apart.where(F.col("holders") <= FEW), apart.where(F.col("holders") > FEW)
    met = _side(few, "_a", scope, keep).join(_side(few, "_b", scope, keep), [*scope, "item"])
    met = met.where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")))
    met = met.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    more = met.where(F.col("n") == 1).drop("n").join(_side(many, "_a", scope, ["item", "id"]), [*scope, "id_a"])
    more = more.join(_side(many, "_b", scope, ["item", "id"]), [*scope, "id_b", "item"])
    return _between(met.where(F.col("n") >= 2)).unionByName(_between(more))


def _common_links(apart: DataFrame, scope: list[str]) -> DataFrame:
    """Components of sets that share two items with many holders."""
    many = apart.where(F.col("holders") > FEW)
    cost = many.groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("_n"), F.sum("holders").alias("_met"))
    ways = many.join(cost, [*scope, "id"]).withColumn("counts", F.col("_met") < F.col("_n") * (F.col("_n") - 1) / 2)
    keep = ["item", "id", "component"]
    counted = _side(ways.where("counts"), "_a", scope, keep).join(_side(many, "_b", scope, keep), [*scope, "item"])
    counted = counted.where(F.col("component_a") != F.col("component_b"))
    counted = counted.groupBy(*scope, "id_a", "id_b", "component_a", "component_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    pairs = ways.where(~F.col("counts")).select(*scope, "id", "item", "component")
    second = pairs.drop("component").withColumnRenamed("item", "second")
    pairs = pairs.withColumnRenamed("item", "first").join(second, [*scope, "id"]).where(F.col("first") < F.col("second"))
    return _between(counted).unionByName(star_edges(pairs.select(*scope, "first", "second", "component").distinct(), [*scope, "first", "second"], node="component"))
