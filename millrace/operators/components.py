"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import few_files, settle, shuffled

#: A node is a hub with more edges than this and than a thousandth of all, so that there are fewer than a thousand.
LEAST_HUB = 64
#: What a hub's edges are dealt over.
SALTS = 128


def salted_join(edges: DataFrame, named: DataFrame, key: str, n_edges: int, by_shuffle: bool = False) -> DataFrame:
    """edges left-joined with named (key, ...; a row for each key); edges of a hub are dealt over SALTS copies of its row.

    The list of hubs is broadcast: as each has a thousandth of n_edges, the number of rows of edges, it has less than a thousand rows.
    by_shuffle: named isn't broadcast, however small the optimizer takes it to be.
    """
    hubs = F.broadcast(edges.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(LEAST_HUB, n_edges // 1000)).select(key, F.lit(True).alias("_hub")))
    others = [c for c in edges.columns if c != key]
    salt = lambda hub: F.when(F.col("_hub"), hub).otherwise(F.lit(0))
    left = edges.join(hubs, key, "left").withColumn("_salt", salt(F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))).drop("_hub")
    copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = named.join(hubs, key, "left").withColumn("_salt", F.explode(copies)).drop("_hub")
    return left.join(shuffled(right) if by_shuffle else right, [key, "_salt"], "left").drop("_salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", n_edges: int | None = None) -> DataFrame:
    """node, component for each node that has an edge; component is the smallest node reachable.

    Every edge points from the larger node to the smaller one. The large star moves what points to a node on to
    the least node that it points to itself; the small star makes all that a node points
    to point to the least of these. Both keep what is connected, edges only become fewer (equal ones are
    one), and when nothing moves any more each component is a star around its smallest node. The number of rounds grows with the
    logarithm of the number of nodes. Each star is settled in the shared folder, in files for its number of edges (at first about
    n_edges, if that is known). Hubs are salted. Null nodes and self loops are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    once = lambda rows: rows.groupBy("child", "root").agg(F.bool_or("moved").alias("moved"))
    least: Column = F.min("root").alias("low")
    stars = settle(few_files(once(pairs.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("root"), F.lit(True).alias("moved"))), n_edges))
    n = stars.count()
    while n:
        up = stars.groupBy("child").agg(least).withColumnRenamed("child", "root")
        large = settle(few_files(once(salted_join(stars.select("child", "root"), up, "root", n).select("child", F.coalesce("low", "root").alias("root"), F.col("low").isNotNull().alias("moved"))), n))
        down = large.groupBy("child").agg(least)
        own = F.col("root") == F.col("low")
        small = salted_join(large, down, "child", n).select(F.when(own, F.col("child")).otherwise(F.col("root")).alias("child"), F.col("low").alias("root"), (F.col("moved") | ~own).alias("moved"))
        stars = settle(few_files(once(small), n))
        n, moved = stars.agg(F.count("*"), F.bool_or("moved")).first()
        if not moved:
            break
    return stars.select(F.col("child").alias("node"), F.col("root").alias("component")).unionAll(stars.select("root", "root").distinct())
