"""Exact top-k of questions against the chunks of their route, block by block.

Chunks and questions of a route are dealt into blocks of bounded size, as many as the
route's counts ask for, whatever its size and whatever its ids look like.  A block pair
is scored in one task, which emits only the best k chunks of each question; the final
cut merges those.  Facts about a route reach its rows by a salted join, so a route with
most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.sources.tables import shuffled

CHUNKS_PER_BLOCK = 2_000
QUESTIONS_PER_BLOCK = 256
SCORE_DIGITS = 6  # ranks use rounded scores, so summation order cannot flip ties

SALTS = 64  # keys that the rows of a route are spread over when they meet a fact about it

_PAIR = ["route", "_cb", "_qb"]


def with_route_facts(rows: DataFrame, facts: DataFrame, spread_by: str) -> DataFrame:
    """Join one row per route to the many rows of it; rows without one go."""
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(shuffled(copies), ["route", "_salt"]).drop("_salt")


def of_routes(rows: DataFrame, routes: DataFrame, spread_by: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of many rows with a table of routes."""
    copies = routes.select("route", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, ["route", "_salt"], how).drop("_salt")


def top_of_block(scores: np.ndarray, chunk_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) positions of the k best per row; equal scores by chunk id."""
    rows, cols = [], []
    for i, line in enumerate(scores):
        if len(line) > 4 * k:
            cut = np.partition(line, len(line) - k)[len(line) - k]
            near = np.flatnonzero(line >= cut)
        else:
            near = np.arange(len(line))
        best = near[np.lexsort((chunk_ids[near], -line[near]))][:k]
        rows.append(np.full(len(best), i))
        cols.append(best)
    return np.concatenate(rows), np.concatenate(cols)


def blocked_topk(
    chunks: DataFrame,
    questions: DataFrame,
    score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray],
    k: int,
    chunks_per_block: int = CHUNKS_PER_BLOCK,
    questions_per_block: int = QUESTIONS_PER_BLOCK,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(question_id, route, chunk_id, score, rank) for the k best chunks per question.

    Both inputs have ``route``; ``score`` maps a chunk block and a question block
    to a matrix with one row per question.  ``counted`` is a cheaper table with the
    routes of the same chunks.
    """
    both = (chunks if counted is None else counted).select(
        "route", F.lit(1).alias("c"), F.lit(0).alias("q")
    ).unionByName(questions.select("route", F.lit(0).alias("c"), F.lit(1).alias("q")))
    facts = both.groupBy("route").agg(
        F.ceil(F.sum("c") / chunks_per_block).alias("_ncb"), F.ceil(F.sum("q") / questions_per_block).alias("_nqb")
    ).where((F.col("_ncb") > 0) & (F.col("_nqb") > 0))

    def dealt(key: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(blocks)), F.col(blocks))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    left = with_route_facts(chunks, facts, "chunk_id").withColumn("_cb", dealt("chunk_id", "_ncb")).withColumn(
        "_qb", every("_nqb")
    ).drop("_ncb", "_nqb")
    right = with_route_facts(questions, facts, "question_id").withColumn(
        "_qb", dealt("question_id", "_nqb")
    ).withColumn("_cb", every("_ncb")).drop("_ncb", "_nqb")

    def best(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asked.empty:
            return pd.DataFrame(
                {"question_id": [], "route": [], "chunk_id": [], "score": []}, dtype=object
            )
        scores = np.round(score(block, asked), SCORE_DIGITS) + 0.0
        ids = block["chunk_id"].to_numpy()
        rows, cols = top_of_block(scores, ids, k)
        return pd.DataFrame({
            "question_id": asked["question_id"].to_numpy()[rows],
            "route": block["route"].iloc[0],
            "chunk_id": ids[cols],
            "score": scores[rows, cols],
        })

    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    qtype = questions.schema["question_id"].dataType.simpleString()
    partial = left.groupBy(*_PAIR).cogroup(right.groupBy(*_PAIR)).applyInPandas(
        best,
        f"question_id {qtype}, route {types['route']}, chunk_id {types['chunk_id']}, score double",
    )
    order = Window.partitionBy("question_id", "route").orderBy(F.desc("score"), "chunk_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
