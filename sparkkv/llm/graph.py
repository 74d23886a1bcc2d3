"""Connected components of a distributed edge list (large-star and small-star rounds), and their smallest ids.

Operators 5 and 8 number distinct contents (nodes) by a hash; rows (id, node) tell which contents an id has, usually one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkkv.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of ``links`` (a, b): root is the smallest node that links lead to.

    Every round writes its edges to the shared folder; the driver sees a count and a checksum. A node with many links is
    pre-aggregated in its minimum, and its join is left to adaptive skew handling. Loops and repeated links are allowed.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("root")))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(id, node0, node1) of the ids of ``rows`` (id, node) with several rows: their smallest and largest node, which differ if they have different contents."""
    found = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m"), F.min("node").alias("node0"), F.max("node").alias("node1"))
    return saved(found.where("m > 1").select("id", "node0", "node1"), "repeated")


def same_id_links(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(a, b): the nodes of each repeated id, linked with the smallest."""
    several = repeated.where("node0 != node1")
    return rows.join(several, "id").where("node != node0").select(F.col("node0").alias("a"), F.col("node").alias("b")).distinct()


def smallest_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of the ``nodes`` (node, first, copies) that have copies or are in ``roots`` (id, root): the smallest id of the component."""
    joint = nodes.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").where("copies > 1 OR root IS NOT NULL")
    joint = saved(joint.select("node", F.coalesce("root", "node").alias("root"), "first"), "joint")
    return joint.join(joint.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")


def empty_rows(rows: DataFrame, repeated: DataFrame, answer: DataFrame) -> DataFrame:
    """``rows`` (id, ..) without a node, with the component_id of the other rows of their id, if there are any."""
    told = repeated.where("node0 IS NOT NULL").join(answer, repeated["node0"] == answer["node"]).select("id", "component_id")
    return rows.join(told, "id", "left")
