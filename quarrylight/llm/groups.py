"""Groups that links form: connected components by alternating stars.

Each round points every node at the least node it knows (large star over the
greater neighbours, small star over the lesser ones), which settles in about
log(n) rounds.  No neighbourhood is ever collected: minima are partial
aggregates joined back to the edges, and each round is written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import near_dup
from quarrylight.session import materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges ``(a, b)`` with a > b: b is a's known lesser node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:  # greater neighbours point at the least
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # lesser neighbours and the node itself do
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``; the root is the least node of its component.

    Raises an error if the components have not settled after ``rounds``, which
    would take a component of some 2^rounds nodes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        edges = materialise(star(star(edges, True), False), "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def similar_groups(rows: DataFrame, key: str, text: str = "text", n: int = 5, threshold: float = 0.8, min_tokens: int = 5) -> DataFrame:
    """``(id, group_id, links)``: one row per key with a text of enough tokens.

    ``group_id`` is the least key of the group that the pairs of
    ``near_dup.similar_pairs`` form, ``links`` the number of pairs the key is
    in.  Copies are counted by their class, never expanded to pairs.  A key
    with two different texts has a row for each.  Nulls, short texts and empty
    tables are handled as there.
    """
    ids = materialise(near_dup.members(rows, key, text, max(n, min_tokens)), "members")
    pairs = materialise(near_dup.similar_classes(rows, text, n, threshold, min_tokens).select("class_a", "class_b"), "links")
    sizes = ids.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.toDF("class", "other").unionByName(pairs.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
    degree = both.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("across"))
    roots = components(pairs.toDF("a", "b")).select(F.col("node").alias("class"), "root")
    placed = sizes.join(degree, "class", "left").join(roots, "class", "left")
    known = ids.join(
        placed.select("class", F.coalesce("root", "class").alias("root"), (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("links")), "class"
    )
    names = known.groupBy("root").agg(F.min("id").alias("group_id"))
    return known.join(names, "root").select("id", "group_id", "links")
