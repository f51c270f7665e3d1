"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import forget, materialise, shared_path


def _with_least(rows: DataFrame, least: DataFrame, hub: int, hubs: bool) -> DataFrame:
    """``rows`` (u, v) with ``least``'s column m of their u.

    Nodes with over ``hub`` of the rows would each meet in one task: their
    rows are joined where they lie to a broadcast list of them. With twice as
    many rows as edges there are at most 2 x edges / hub of them, a number
    that ``hub_size`` bounds.
    """
    if not hubs:
        return rows.join(least.drop("n"), "u")
    heavy = F.broadcast(least.where(F.col("n") > hub).drop("n"))
    light = rows.join(heavy, "u", "left_anti").join(least.where(F.col("n") <= hub).drop("n"), "u")
    return light.unionByName(rows.join(heavy, "u"))


def hub_size(edges: int, partitions: int, least: int = 1000) -> int:
    """Edges from which a node is a hub: twice a partition's share, so that there are at most ``partitions`` (or 2 x edges / ``least``) hubs."""
    return max(least, 2 * edges // max(1, partitions))


def _large_star(edges: DataFrame, hub: int, hubs: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both, least, hub, hubs).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int, hubs: bool) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    to_least = _with_least(down, least, hub, hubs).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, hub: int | None = None, between: Callable[[], None] | None = None) -> DataFrame:
    """One row (node, component) for each node that has an edge; a component's id is its smallest node.

    Each round contracts stars (two joins and distinct edges), is written to
    the shared folder, and the rounds end when an edge set repeats. Where a
    node, by all its edges, is a hub (see ``hub_size``), the round's joins
    leave hubs' edges where they lie. ``between`` is called after each round.
    Nodes without edges, and edges with a null end, are left out.
    """
    spark = edges.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    path = shared_path(spark, "components")
    now, mark = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "", path), None

    def state(e: DataFrame) -> tuple:
        """(edges, a hash of them all, most edges of a node)."""
        ends = e.select(F.explode(F.array("u", "v")).alias("x"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
        by_node = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
        got = by_node.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first()
        return got[0] // 2, got[1], got[2]

    n, _, most = state(now)
    for _ in range(max_rounds):
        bar = hub or hub_size(n, partitions)
        after = _small_star(_large_star(now, bar, most > bar), bar, most > bar).where("u <> v").distinct()
        new = shared_path(spark, "components")
        after = materialise(after, "", new)
        n, seen, most = state(after)
        forget(spark, path)
        if between:
            between()
        now, path, done, mark = after, new, (n, seen) == mark, (n, seen)
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
