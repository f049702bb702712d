"""From candidate buckets to connected components, without listing all pairs of a bucket.

Members of a bucket are first compared with two pivots (the id of the largest weight, which most others are copies of, and an end of the range of ids).  Links
that verify are joined up to components; only buckets in which several components are left are
looked at again, without their pivots, and there only pairs across components, with one side outside
the pivot's component, are made.  No link is lost: a pair is left out only if it has been verified
or both ends are already known to be in one component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _lowest(rows: DataFrame) -> DataFrame:
    """(a, low) for (a, b).  Written, so that a join with it has two plain exchanges and can be split where one id has many edges."""
    return written(rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, component): every id of an edge with the smallest id reachable.

    Alternating large-star and small-star steps, each a partial aggregation and a join; each step's
    edges are written to the shared folder.  An empty table gives an empty table; repeated edges and
    loops do no harm.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = _lowest(both)
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct())
        drop(edges, low)
        low = _lowest(large)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = written(small)
        drop(large, low)
        state = edges.agg(F.count("*"), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known or state[0] == 0:
            break
        known = state
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], both_pivots: bool = True) -> DataFrame:
    """(key, id, weight) to (a, b): links that connect just what all verified pairs within keys connect.

    members: written table, deleted when it has been used; several rows of an id in a key do no harm.
    verify: keeps the rows of an (a, b) table that are links.
    both_pivots: compare with the second pivot too; where verifying costs more than looking at more buckets again, one will do.
    across: from (key, id, part, main) of the buckets that still hold several components beside their pivots, candidate
    pairs that include, for every id outside its bucket's main component and every other component
    that it has links to in the bucket, at least one of these links.
    """
    pivots = written(members.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("id")).alias("i"), F.col("id").alias("id"))).alias("heavy"), F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("key", F.col("heavy.id").alias("low"), F.when(F.col("heavy.id") == F.col("high"), F.col("low")).otherwise(F.col("high")).alias("high")))
    busy = written(members.select("key", "id").join(pivots, "key"))
    drop(members, pivots)
    return link_to_pivots(busy, verify, across, both_pivots)


def link_to_pivots(busy: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], both_pivots: bool = False) -> DataFrame:
    """link for members that know their key's pivots already: (key, id, low), and high for both_pivots; keys have two ids at least."""
    pair = lambda x: F.struct(F.greatest("id", x).alias("a"), F.least("id", x).alias("b"))
    pairs = busy.select(F.explode(F.array(pair("low"), *[pair("high")] * both_pivots)).alias("p")).select("p.*").where("a != b").distinct()
    first = written(verify(pairs))
    part = components(first)
    labelled = written(busy.join(part, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    drop(busy)
    # The pivot's own component counts as the bucket's main one; whoever is outside it meets all the others but the pivot, which has met everyone.
    pivot = F.col("id") == F.col("low")
    of_others = F.when(~pivot, F.col("part"))
    open_keys = written(labelled.groupBy("key").agg(F.min(of_others).alias("p"), F.max(of_others).alias("q"), F.min(F.when(pivot, F.col("part"))).alias("main")).where("p != q").select("key", "main"))
    still = written(labelled.where(~pivot).join(open_keys, "key").select("key", "id", "part", "main"))
    drop(labelled, open_keys)
    more = written(verify(across(still).select("a", "b").distinct()))
    drop(still)
    return first.select("a", "b").union(more.select("a", "b"))
