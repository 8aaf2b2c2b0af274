"""Ordered operators that never put a whole group in one task.

A group is cut into segments by its integer ordinal.  Windows run per
(group, segment); one summary row per segment carries state forward.  A group
with a single segment has no carry rows, so adaptive execution drops that join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096


def segment_of(order: str | Column, length: int = SEGMENT) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(length)).cast("long")


def _carry_join(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, "_seg"], "left")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column],
    seg_len: int = SEGMENT, inclusive: bool = True,
) -> DataFrame:
    """Add, per output name, the sum of its value up to this row of the group."""
    df = df.withColumn("_seg", segment_of(order, seg_len)).withColumns(
        {f"_v_{out}": value for out, value in sums.items()}
    )
    end = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        df.groupBy(*keys, "_seg")
        .agg(*[F.sum(f"_v_{out}").alias(f"_s_{out}") for out in sums])
        .select(*keys, "_seg", *[F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in sums],
                F.row_number().over(before.orderBy("_seg").rowsBetween(
                    Window.unboundedPreceding, Window.currentRow)).alias("_nth"))
        .where(F.col("_nth") > 1)
        .drop("_nth")
    )
    local_sums = df.withColumns(
        {out: F.coalesce(F.sum(f"_v_{out}").over(local), F.lit(0)) for out in sums}
    )
    return (
        _carry_join(local_sums, carry, keys)
        .withColumns({o: F.col(o) + F.coalesce(f"_c_{o}", F.lit(0)) for o in sums})
        .drop("_seg", *[f"_v_{o}" for o in sums], *[f"_c_{o}" for o in sums])
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    following: bool = False, seg_len: int = SEGMENT,
) -> DataFrame:
    """Nearest non-null ``value`` strictly before (or after) each row of its group."""
    df = df.withColumn("_seg", segment_of(order, seg_len)).withColumn("_v", value)
    if following:
        frame = (1, Window.unboundedFollowing)
        pick, nearest = F.first, F.min_by
    else:
        frame = (Window.unboundedPreceding, -1)
        pick, nearest = F.last, F.max_by
    local = Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(*frame)
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(*frame)
    carry = (
        df.groupBy(*keys, "_seg")
        .agg(nearest("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_n"))
        .select(*keys, "_seg", pick("_n", ignorenulls=True).over(across).alias("_carry"))
        .where(F.col("_carry").isNotNull())
    )
    return (
        _carry_join(df.withColumn(out, pick("_v", ignorenulls=True).over(local)), carry, keys)
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_seg", "_v", "_carry")
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, seg_len: int = SEGMENT
) -> DataFrame:
    """Dense 0-based position per group; ``order[0]`` is an integer ordinal with few ties."""
    df = df.withColumn("_seg", segment_of(order[0], seg_len))
    before = (
        Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        df.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_seg", F.sum("_n").over(before).alias("_carry"))
        .where(F.col("_carry").isNotNull())
    )
    local = Window.partitionBy(*keys, "_seg").orderBy(*order)
    return (
        _carry_join(df.withColumn(out, F.row_number().over(local) - 1), carry, keys)
        .withColumn(out, (F.col(out) + F.coalesce("_carry", F.lit(0))).cast("long"))
        .drop("_seg", "_carry")
    )


def stream_states(
    summaries: DataFrame, keys: Sequence[str], seg: str, initial: Callable[[], dict],
    step: Callable[[dict, dict], dict], state_schema: str,
) -> DataFrame:
    """State on entry to each segment, folding one small summary row per segment.

    Rows of a group are read in order from Spark's spillable sort; only the
    current state is held.  ``step(state, summary_row)`` returns the next state.
    """
    names = list(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                key = tuple(row[n] for n in names)
                if key != current:
                    current, state = key, initial()
                rows.append({**dict(zip(names, key)), seg: row[seg], **state})
                state = step(state, row)
            if rows:
                yield pd.DataFrame(rows)

    key_types = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in summaries.schema if f.name in {*names, seg}
    )
    return (
        summaries.repartition(*keys)
        .sortWithinPartitions(*keys, seg)
        .mapInPandas(fold, f"{key_types}, {state_schema}")
    )
