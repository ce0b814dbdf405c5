"""Connected components of a graph of 64-bit node ids by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut

#: Neighbours of a node that one task of a star join reads at most, on average.
NEIGHBOURS = 100_000


def _forest(batches):
    """(node, least node that this partition's links reach) for the links of a partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = z = up.get(y, y)
            x = z
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([root(x) for x in part], pa.int64())})


def _meet(links: DataFrame, least: DataFrame, salts: int) -> DataFrame:
    """links (u, v) with the least neighbour m of u; neighbours of very large stars are dealt over ``salts`` tasks."""
    if salts == 1:
        return links.join(least, "u")
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (two columns of node ids); root is the least id of the component.

    First each partition shrinks its links to a forest. Then nodes hand their neighbours to their least
    neighbour until nothing changes, a number of rounds that is logarithmic in the size of a component.
    Each round ends on shared storage; only counts come to the driver.
    """
    a, b = links.columns
    e = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").mapInArrow(_forest, "a bigint, b bigint").distinct())
    before = None
    while True:
        # links point from larger to smaller ids
        stats = e.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if stats[0] is None or (stats[0], stats[1]) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, salts = (stats[0], stats[1]), stats[2] // NEIGHBOURS + 1
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _meet(both, least, salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _meet(large, least, 1).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.*")
        e = cut(small.filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct())
