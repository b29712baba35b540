"""Paths and cycles of edge tables, in a number of rounds that grows with the logarithm of their length.

What rounds make is written as tables: a checkpoint would hand on what the optimizer has inferred, which doubles with every
round that renames columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle, settle_table


def closure(edges: DataFrame, src: str, dst: str, deepest: int | None = None) -> DataFrame:
    """Every node with each node below it and the least number of edges between: (ancestor, descendant, depth).

    Paths double: who is more than 2^k edges below is at most 2^k below someone that is exactly 2^k below. So each round
    joins the pairs of the last depth with all pairs, and adds pairs that no round before had; cycles end by
    themselves. With `deepest`, pairs further apart are left out.
    """
    depth = F.lit(1).alias("depth")
    reach = settle(edges.select(F.col(src).alias("ancestor"), F.col(dst).alias("descendant"), depth).where("ancestor IS NOT NULL AND descendant IS NOT NULL").distinct())
    rounds, far = [reach], 1
    while deepest is None or far < deepest:
        last = reach.where(F.col("depth") == far).select("ancestor", F.col("descendant").alias("middle"))
        below = reach.select(F.col("ancestor").alias("middle"), "descendant", "depth")
        longer = last.join(below, "middle").groupBy("ancestor", "descendant").agg((F.min("depth") + far).cast("int").alias("depth"))
        if deepest is not None:
            longer = longer.where(F.col("depth") <= deepest)
        new = settle_table(longer.join(reach.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        if new.isEmpty():
            break
        rounds.append(new)
        reach, far = reduce(DataFrame.unionByName, rounds), far * 2
    return reduce(DataFrame.unionByName, rounds)


def _raked(edges: DataFrame) -> DataFrame:
    """edges without those from nodes that nothing leads to, and to nodes that lead nowhere."""
    ends, starts = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return edges.join(ends, "a", "left_semi").join(starts, "b", "left_semi")


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (id, a, b, length) whose chains are one edge each, where each edge went (id, into), and rings (id, ring, length).

    A link is a node with one edge in and one out. Each edge looks back over links, twice as far in every round, until it
    meets an edge that begins at another node: the head of its chain. Edges that meet none lie on a ring of links.
    """
    into = edges.groupBy("b").agg(F.count("*").alias("n"), F.max("id").alias("before"))
    out = edges.groupBy("a").agg(F.count("*").alias("n"))
    links = into.where("n = 1").join(out.where("n = 1"), F.col("b") == F.col("a"), "left_semi").select("b", "before")
    state = settle(edges.join(links.withColumnRenamed("b", "a"), "a", "left").select("id", F.coalesce("before", "id").alias("back"), F.col("before").isNull().alias("done"), F.col("id").alias("low")))
    met, looking = [state.where("done")], state.where("NOT done")
    longest, far = looking.count(), 1
    while far <= longest and not looking.isEmpty():
        further = reduce(DataFrame.unionByName, met, looking).select(F.col("id").alias("back"), F.col("back").alias("to"), F.col("done").alias("there"), F.col("low").alias("lower"))
        moved = settle_table(looking.join(further, "back").select("id", F.col("to").alias("back"), F.col("there").alias("done"), F.least("low", "lower").alias("low")))
        met.append(moved.where("done"))
        looking = moved.where("NOT done")
        far *= 2
    rings = edges.join(looking.select("id", F.col("low").alias("ring")), "id")
    rings = rings.select("id", "ring").join(rings.groupBy("ring").agg(F.sum("length").alias("length")), "ring")
    gone = reduce(DataFrame.unionByName, met).select("id", F.col("back").alias("into"))
    linked = edges.join(gone, "id").join(links.select("b", F.lit(True).alias("link")), "b", "left")
    last = F.max(F.when(F.col("link").isNull(), F.col("b")))  # one edge of a chain ends at a node that is no link
    first = F.max(F.when(F.col("id") == F.col("into"), F.col("a")))
    chains = linked.groupBy("into").agg(first.alias("a"), last.alias("b"), F.sum("length").alias("length")).withColumnRenamed("into", "id")
    return settle_table(chains), settle_table(gone), settle_table(rings)


def _nearest(edges: DataFrame) -> DataFrame:
    """a, b, length of the shortest way between any two nodes of edges; ways double until none gets shorter."""
    best = settle(edges.groupBy("a", "b").agg(F.min("length").alias("length")))
    while True:
        on = best.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("length").alias("more"))
        longer = best.join(on, "b").groupBy("a", F.col("c").alias("b")).agg(F.min(F.col("length") + F.col("more")).alias("found"))
        both = settle_table(best.join(longer, ["a", "b"], "full").select("a", "b", F.least("length", "found").alias("length"), (F.col("length").isNull() | (F.col("found") < F.col("length"))).alias("better")))
        best = both.drop("better")
        if both.where("better").isEmpty():
            return best


def cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes that lie on a cycle, with the length of the shortest one through them.

    Trees are raked off and chains compressed to one edge, by turns, which takes a logarithmic number of rounds
    for trees, chains and rings. Shortest ways are looked for between the nodes that are left then, where paths part and meet.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    left = settle(_raked(pairs.withColumns({"id": F.monotonically_increasing_id(), "length": F.lit(1).cast("long")})))
    ends = left.select("id", F.col("b").alias("node"))  # an edge stands for the node that it leads to
    inside, found = settle(left.select(F.col("id").alias("own"), "id")), []
    n = left.count()
    while n:
        left, gone, rings = _compressed(left)
        found.append(inside.join(rings, "id").select("own", "length"))
        inside = settle_table(inside.join(gone, "id").select("own", F.col("into").alias("id")))
        left = settle_table(_raked(left))
        before, n = n, left.count()
        if n == before:
            break
    if n:
        back = _nearest(left).select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("length").alias("more"))
        ways = left.withColumn("more", F.when(F.col("a") == F.col("b"), 0)).where("more = 0").unionByName(left.join(back, ["a", "b"]).select(*left.columns, "more"))
        found.append(ways.select("id", (F.col("length") + F.col("more")).alias("length")).join(inside, "id").select("own", "length"))
    if not found:
        return left.select(F.col("b").alias("node"), F.col("length").cast("int"))
    told = reduce(DataFrame.unionAll, found).join(ends, F.col("own") == F.col("id"))
    return told.groupBy("node").agg(F.min("length").cast("int").alias("length"))
