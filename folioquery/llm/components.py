"""Connected components of a link table, by alternating large and small stars.

Every pass hangs each node under the smallest node it sees, with an aggregate per node
and an equality join that may split a hot node; no neighbourhood is collected. Passes end
when the links no longer change, which takes a number of passes logarithmic in the
longest chain. Each pass is a stage table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )).alias("e")).select("e.*")


def _hang(around: DataFrame, keep_larger: bool) -> DataFrame:
    """Replace links (u, v) by links of v (and, for small stars, of u) to the smallest node around u."""
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "k").alias("m"))
    joined = around.join(least, around["u"] == least["k"])
    if keep_larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    return tuple(row)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Component of every linked node: id, component (the smallest id it reaches).

    ``edges`` has long columns a and b. Loops and repeated links are allowed; null ends
    are ignored. Nodes without a link to another node are not returned.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stage(links, name)
    before = _mark(links)
    while before[0]:
        large = _hang(_both_ways(links), keep_larger=True)
        small = _hang(
            large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), keep_larger=False
        )
        links = stage(small, name)
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b"), F.col("b")).distinct()
    )
