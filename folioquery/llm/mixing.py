"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic, in tokens. Raking scales
the cells until their sums along every dimension meet the targets; a cell's factor is
the probability with which its documents are kept, at most 1. A document is kept when
the hash of its id (of its text, if it has no id), as a number in [0, 1), lies below the
probability: the same documents in every run, whatever the partitioning.

A value that a target does not name belongs to the cell value "other", whose share stays
as observed; so there are at most the product of the targets' sizes plus one of cells,
whatever the corpus holds, and the cells may be gathered and broadcast.

Defined results: null values count as "other"; a null or empty text has no tokens and
does not sway the fit; rows of one id, and rows without id of one text, are kept or dropped
together; extra columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import packed, read, unpacked

OTHER = "other"
#: Target shares of the named values among all named values of a dimension.
TARGETS = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0},
    "topic": {str(i): 1.0 for i in range(10)},
}
#: Share of all tokens to keep.
FRACTION = 0.5
CYCLES = 200
SEED = 11


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """topic_id (a doc_id), topic_value: the label of the document's vector."""
    return read(spark, folder, "embeddings").groupBy(F.col("vec_id").alias("topic_id")).agg(
        F.min("label").cast("string").alias("topic_value")
    )


def rake(cells: dict[tuple[str, ...], int], targets: dict[str, dict[str, float]], fraction: float) -> dict:
    """Keeping probability of every cell."""
    keys = [k for k, n in cells.items() if n > 0]
    p = dict.fromkeys(cells, fraction)
    if not keys:
        return p
    size = np.array([cells[k] for k in keys], float)
    total = size.sum()
    wanted = []
    for d, name in enumerate(targets):
        values = sorted({k[d] for k in keys})
        index = np.array([values.index(k[d]) for k in keys])
        seen = np.bincount(index, size)
        share = np.array([targets[name].get(v, 0.0) for v in values])
        other = np.array([v not in targets[name] for v in values])
        goal = np.where(other, seen, 0.0)
        if share.sum():
            goal += share / share.sum() * (total - goal.sum())
        wanted.append((index, fraction * goal))
    q = np.full(len(keys), fraction)
    for _ in range(CYCLES):
        before = q.copy()
        for index, goal in wanted:
            now = np.bincount(index, size * q, len(goal))
            q = np.minimum(1.0, q * np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)[index])
        if np.abs(q - before).max() < 1e-10:
            break
    p.update(zip(keys, map(float, q), strict=True))
    return p


def mix(
    docs: DataFrame, topic: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION
) -> DataFrame:
    """doc (the whole row), doc_id, source, lang, mix_tokens, mix_topic, mix_probability, mix_kept."""
    targets = targets or TARGETS
    spark = docs.sparkSession
    # tokens are counted before the join, so that a caller who drops the text does not move it
    counted_docs = packed(
        docs, "doc_id", "source", "lang", tokens(F.col("text")).alias("mix_tokens"), F.xxhash64("text").alias("mix_text")
    )
    # rows without an id have no topic and would all meet in one task
    marked = counted_docs.filter("doc_id is not null").join(topic, F.col("doc_id") == F.col("topic_id"), "left").drop(
        "topic_id"
    ).unionByName(counted_docs.filter("doc_id is null"), allowMissingColumns=True)
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic_value")}
    for name, column in values.items():
        known = column.isin(list(targets[name]))
        marked = marked.withColumn(f"mix_{name}", F.when(known, column).otherwise(OTHER))
    marked = marked.drop("topic_value")
    cell = [f"mix_{name}" for name in values]
    counted = marked.groupBy(*cell).agg(F.sum("mix_tokens").alias("n")).collect()
    chance = rake({tuple(r[:3]): r["n"] for r in counted}, {k: targets[k] for k in values}, fraction)
    known_cells = itertools.product(*[[*targets[name], OTHER] for name in values])
    table = spark.createDataFrame(
        [(*c, chance[c]) for c in known_cells if c in chance],
        "mix_source string, mix_lang string, mix_topic string, mix_probability double",
    )
    drawn_by = F.xxhash64(F.when(F.col("doc_id").isNull(), F.col("mix_text")).otherwise(F.col("doc_id")), F.lit(SEED))
    draw = F.pmod(drawn_by, F.lit(1 << 52)) / float(1 << 52)
    # as many rows as the targets have cells
    return marked.join(F.broadcast(table), cell).withColumn("mix_kept", draw < F.col("mix_probability")).drop(
        "mix_source", "mix_lang", "mix_text"
    )


def keep_mixed(docs: DataFrame, folder: str) -> DataFrame:
    """The sampled documents with their own columns."""
    return unpacked(mix(docs, topics(docs.sparkSession, folder)).filter("mix_kept"), docs.columns)
