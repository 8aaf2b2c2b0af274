"""Dense vectors: normalization, exact cosine search, embedding batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.blocks import blocked_topk
from folioquery.operators.ordered import segment_of, stream_states


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))
    # The one-element array makes the norm a lambda variable: computed once per row.
    return F.transform(
        F.array(norm),
        lambda n: F.transform(
            vector, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")
        ),
    )[0]


def _dot(block: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    chunks = np.stack(block["embedding"].to_list()).astype("float64")
    return np.stack(asked["embedding"].to_list()).astype("float64") @ chunks.T


def cosine_topk(chunks: DataFrame, questions: DataFrame, k: int = 30, **blocks) -> DataFrame:
    """Best k chunks by inner product of unit vectors, per question and route."""
    return blocked_topk(
        chunks.select("route", "chunk_id", "embedding"),
        questions.select("route", "question_id", "embedding"), _dot, k, **blocks,
    )


# ---- embedding request batches -------------------------------------------------

def _batch_exits(batch_size: int, budget: int):
    @F.pandas_udf("struct<n:array<int>,tok:array<int>,start:array<bigint>>")
    def exits(prior: pd.Series, rows: pd.Series) -> pd.DataFrame:
        """Open batch after a segment, for each number of rows already open at its start.

        ``prior`` holds the token counts just before the segment, nearest last.
        """
        out = []
        for before, items in zip(prior, rows):
            before = np.asarray(before, dtype="int64")
            n = np.arange(len(before) + 1)
            tok = np.concatenate([[0], np.cumsum(before[::-1])])
            start = np.full(len(n), -1, dtype="int64")
            for r in items:
                full = (n > 0) & ((n >= batch_size) | (tok + r["toks"] > budget))
                opens = full | (n == 0)
                start = np.where(opens, r["pos"], start)
                n = np.where(opens, 1, n + 1)
                tok = np.where(opens, r["toks"], tok + r["toks"])
            if (start == start[0]).all() and start[0] >= 0:
                n, tok, start = n[:1], tok[:1], start[:1]
            out.append((n.tolist(), tok.tolist(), start.tolist()))
        return pd.DataFrame(out, columns=["n", "tok", "start"])

    return exits


def embedding_batches(
    chunks: DataFrame, key: str = "doc_id", pos: str = "chunk_id", tokens: str = "length_tokens",
    batch_size: int = 32, budget: int = 3200, seg_len: int = 1024,
) -> DataFrame:
    """Add ``batch_start``: position of the first row of the embedding request of a row.

    A request closes when it holds ``batch_size`` rows or the next row would take it
    over ``budget`` tokens; a single row over the budget is a request of its own.
    A segment depends on the ones before only through the rows still open, at most
    ``batch_size``, whose token counts are handed over with it.
    """
    rows = chunks.select(
        F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"),
        F.col(tokens).cast("int").alias("toks"),
    )
    item = F.struct("pos", "toks")
    segs = (
        rows.withColumn("seg", segment_of("pos", seg_len)).groupBy("key", "seg")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .withColumn("chained", (F.col("seg") > 0) | (F.size("items") == seg_len))
    )
    tails = segs.where("chained").select(
        "key", (F.col("seg") + 1).alias("seg"),
        F.transform(
            F.slice("items", F.greatest(F.size("items") - batch_size + 1, F.lit(1)), batch_size),
            lambda r: r["toks"],
        ).alias("prior"),
    )
    summary = segs.where("chained").join(tails, ["key", "seg"], "left").select(
        "key", "seg",
        _batch_exits(batch_size, budget)(
            F.coalesce("prior", F.array().cast("array<int>")), F.col("items")
        ).alias("exits"),
    )

    def step(state: dict, row: dict) -> dict:
        e = row["exits"]
        at = 0 if len(e["start"]) == 1 else state["n"]
        start = int(e["start"][at])
        return {
            "n": int(e["n"][at]), "tok": int(e["tok"][at]),
            "start": start if start >= 0 else state["start"],
        }

    entries = stream_states(
        summary, ["key"], "seg", lambda: {"n": 0, "tok": 0, "start": -1}, step,
        "n int, tok int, start bigint",
    )
    state_type = "struct<n:int,tok:int,start:bigint,out:array<bigint>>"

    def visit(s: Column, r: Column) -> Column:
        opens = (s["n"] == 0) | (s["n"] >= batch_size) | (s["tok"] + r["toks"] > budget)
        start = F.when(opens, r["pos"]).otherwise(s["start"])
        return F.struct(
            F.when(opens, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(opens, r["toks"]).otherwise(s["tok"] + r["toks"]).alias("tok"),
            start.alias("start"),
            F.concat(s["out"], F.array(start)).alias("out"),
        ).cast(state_type)

    initial = F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tok", F.lit(0)).alias("tok"),
        F.coalesce("start", F.lit(-1)).alias("start"),
        F.array().cast("array<bigint>").alias("out"),
    ).cast(state_type)
    starts = F.aggregate("items", initial, visit, lambda s: s["out"])
    return (
        segs.join(entries, ["key", "seg"], "left")
        .select("key", F.inline(F.arrays_zip("items", starts.alias("starts"))))
        .select(
            F.col("key").alias(key), F.col("items.pos").alias(pos),
            F.col("items.toks").alias(tokens), F.col("starts").alias("batch_start"),
        )
    )
