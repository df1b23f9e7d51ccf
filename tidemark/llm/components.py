"""Connected components of an edge table, distributed: alternating large and small stars until nothing changes; whole numbers for ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def _linked(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (least node that links reach) of every node of the edges (a, b); others are left out.

    A node's least neighbour is found with partial aggregates, and the join that
    hands it on can be split by AQE, so a hub does not fill one task.
    """
    now = scratch.table(_linked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _linked(both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = _linked(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        after = scratch.table(small)
        new = _state(after)
        scratch.drop(now)
        now = after
        if new == state:
            break
        state = new
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)


def forest(linked, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of ``n`` nodes; ``linked(i, rest)`` tells which of the nodes ``rest`` link with ``i``.

    Only nodes that no edge has reached are compared, so a dense group takes few comparisons.
    """
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            if hit.any():
                found = rest[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                rest = rest[~hit]
    return edges


class Numbered:
    """Rows with their column ``id`` as whole numbers in the order of the ids; ids that are whole numbers are their own."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.ids = rows.select("id")
        if rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
            self.kind, self.numbers = rows.schema["id"].dataType, None
            self.rows = rows.withColumn("id", F.col("id").cast("long"))
            return
        # A sorted table's partitions are in order, so numbers that grow within and between them keep it.
        own = rows.select("id").filter(F.col("id").isNotNull()).distinct().orderBy("id")
        self.numbers = scratch.table(own.select("id", F.monotonically_increasing_id().alias("number")))
        self.rows = rows.join(self.numbers, "id", "left").withColumn("id", F.col("number")).drop("number")

    def back(self, found: DataFrame, names: list[str]) -> DataFrame:
        """``found`` by ``id``, joined to the ids of the rows, one row for each; ``names`` are columns with ids too."""
        if self.numbers is None:
            found = found.select(F.col("id").alias("_n"), *(F.col(c).cast(self.kind).alias(c) if c in names else F.col(c) for c in found.columns if c != "id"))
            return self.ids.join(found, F.col("id") == F.col("_n"), "left").drop("_n")
        for name in ["id", *names]:
            own = self.numbers.select(F.col("number").alias("_n"), F.col("id").alias("_id"))
            found = found.join(own, F.col(name) == F.col("_n"), "left").drop(name, "_n").withColumnRenamed("_id", name)
        return self.ids.join(found.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n"), "left").drop("_n")
