"""Second-stage ranking from model relevance and the fused score."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODEL_WEIGHT = 0.7
BATCH = 10
TOP_N = 6
WEAK_THRESHOLD = 0.5


def with_batches(candidates: DataFrame, batch: int = BATCH) -> DataFrame:
    """Request number of each candidate: ``batch`` blocks to a request, in rank order."""
    return candidates.withColumn("batch_no", F.floor((F.col("rank") - 1) / batch).cast("int"))


def combine_rankings(
    scored: DataFrame, keys: list[str], model_weight: float = MODEL_WEIGHT, top_n: int = TOP_N
) -> DataFrame:
    """Rounded weighted mean of ``relevance_score`` and the rounded fused ``score``.

    The best ``top_n`` are kept; equal combined scores keep their fused order.
    Decimal arithmetic makes the rounding, and with it the ties, exact.
    """
    weight = Decimal(str(model_weight))
    combined = F.round(
        F.lit(weight) * F.col("relevance_score").cast("decimal(7,6)")
        + F.lit(1 - weight) * F.col("score").cast("decimal(7,4)"),
        4,
    ).cast("double")
    order = Window.partitionBy(*keys).orderBy(F.desc("combined_score"), "rank")
    return (
        scored.withColumn("combined_score", combined)
        .withColumn("rerank", F.row_number().over(order))
        .where(F.col("rerank") <= top_n)
    )


def weak_evidence(relevances: Column, threshold: float = WEAK_THRESHOLD) -> Column:
    """Whether the best relevance is at or below the threshold; 0 switches it off."""
    top = F.coalesce(F.max(relevances), F.lit(0.0))
    return F.lit(threshold > 0) & (top <= threshold)
