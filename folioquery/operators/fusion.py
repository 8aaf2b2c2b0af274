"""Min-max fusion of the dense and the lexical hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.operators.blocks import SCORE_DIGITS

VECTOR_WEIGHT = 0.6
TOP_N = 20


def min_max(value: Column, window) -> Column:
    """Scale to [0, 1] within the window; a list without spread becomes all ones."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high - low <= 1e-9, 1.0).otherwise((value - low) / (high - low))


def fuse_hits(
    vector_hits: DataFrame, lexical_hits: DataFrame,
    vector_weight: float = VECTOR_WEIGHT, top_n: int = TOP_N,
) -> DataFrame:
    """Full outer join of both lists on the chunk; a missing side counts as 0.

    Ordered by the fused score before it is rounded for output, then by chunk id.
    """
    keys = ["question_id", "route"]
    list_of = Window.partitionBy(*keys)
    sides = [
        hits.select(*keys, "chunk_id", min_max(F.col("score"), list_of).alias(name))
        for hits, name in ((vector_hits, "_v"), (lexical_hits, "_b"))
    ]
    v, b = F.coalesce("_v", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    joined = sides[0].join(sides[1], [*keys, "chunk_id"], "full_outer").select(
        *keys, "chunk_id", v.alias("_v"), b.alias("_b"),
        (vector_weight * v + (1 - vector_weight) * b).alias("_f"),
    )
    order = list_of.orderBy(F.desc(F.round("_f", SCORE_DIGITS)), "chunk_id")
    return (
        joined.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select(
            *keys, "chunk_id", "rank", F.round("_v", 4).alias("score_vec"),
            F.round("_b", 4).alias("score_bm25"), F.round("_f", 4).alias("score"),
        )
    )
