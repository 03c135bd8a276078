"""Connected components of a table of links, by distributed label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, drop, keep


def _lookup(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """rows joined by key with table (key, n: how many of at most `total` rows have it, and more), hot keys by broadcast.

    Keys with more than total / SMALL_ROWS rows are SMALL_ROWS at most, whatever the input; the others put that many rows in
    one task at most. So no hub's neighbours meet in one task.
    """
    most = max(1000, -(-total // SMALL_ROWS))
    hot = F.broadcast(table.where(F.col("n") > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= most), key)
    return rows.join(hot, key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of comparable ids, in any order, repeats allowed. Returns (id, root), root the smallest id reachable.

    Large-star and small-star steps in turn until only stars are left: each node hands its neighbours to its
    smallest neighbour. Both steps are aggregations and lookups of ids, so a hub of any size is a partial minimum
    and a broadcast row, never a collected group. The number of rounds grows with the logarithm of the longest
    chain. Every round is written to the shared folder. No links: an empty table.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("k"), F.col("a").alias("o")))
        nodes = keep(ends.groupBy("k").agg(F.min("o").alias("m"), F.count_if(F.col("o") < F.col("k")).alias("down"), F.count_if(F.col("o") > F.col("k")).alias("n")), "nodes")
        total, open_ = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("n") > 0))), F.lit(False))).first()
        if not open_:  # every node has one edge down, to a node that has none
            break
        # Large star: neighbours above a node go to its smallest neighbour (or itself).
        low = nodes.where("n > 0").select(F.col("k").alias("b"), F.least("k", "m").alias("m"), "n")
        large = keep(_lookup(edges, "b", low, total).select("a", F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        # Small star: neighbours below a node, and the node, go to its smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = _lookup(large, "a", low.where("n > 1"), total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = keep(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for old in (edges, nodes, large):
            drop(old)
        edges = small
    drop(nodes)
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return out.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
