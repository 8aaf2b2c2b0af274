"""Model stages over elements and chunks: tables, pictures, prose rewriting, embedding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import (
    normalize_text, numeric_conservation, strip, token_count, token_truncate, truthy,
)
from folioquery.operators import models
from folioquery.operators.context import adjacent_prose, picture_context, table_context
from folioquery.operators.elements import is_large_table
from folioquery.operators.slices import frame_slices
from folioquery.operators.vectors import embedding_batches, l2_normalize
from folioquery.sources import stages
from folioquery.sources.tables import shuffled, stage

SERIALIZED = (
    "struct<subject_core_entities_list:array<string>,relevant_headers_list:array<string>,"
    "information_blocks:array<struct<subject_core_entity:string,information_block:string>>>"
)
EMBED_TOKEN_CAP = 8000


def _quoted(label: str, text: Column) -> Column:
    return F.when(
        F.length(text) > 0, F.concat(F.lit(f'{label}\n"""'), text, F.lit('"""'))
    )


# ---- tables -----------------------------------------------------------------------------


def table_requests(tables: DataFrame, elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Tables with the prompt of their rewriting: company, surroundings, caption, HTML."""
    large = F.when(
        is_large_table(F.coalesce("html", F.lit(""))),
        F.lit("The table is very large: group related rows, at most 40 compact blocks."),
    )
    company = F.when(
        truthy(F.col("company")).isNotNull(),
        F.concat(F.lit("Table from the annual report of "), "company", F.lit(".")),
    )
    caption = F.when(
        F.length(strip(F.col("caption"))) > 0,
        F.concat(F.lit("Caption: "), strip(F.col("caption")), F.lit("\n")),
    ).otherwise("")
    prompt = F.concat_ws(
        "\n\n", company, _quoted("Text before the table:", F.col("before")),
        F.concat(caption, F.lit('Table:\n"""'), F.coalesce("html", F.lit("")), F.lit('"""')),
        _quoted("Text after the table:", F.col("after")), large,
    )
    return (
        tables.join(table_context(elements).drop("page"), ["doc_id", "table_id"])
        .join(docs.select("doc_id", "company"), "doc_id", "left")
        .withColumn("prompt", prompt)
    )


def serialize_tables(
    tables: DataFrame, elements: DataFrame, docs: DataFrame, model: models.Model,
    limit: int | None = None, **calls,
) -> DataFrame:
    """Fill ``serialized`` of the tables that lack it; a failed table stays pending.

    All tables come back, so a report without any pending one is kept as well.
    """
    todo = table_requests(stages.pending_tables(tables, limit), elements, docs)
    asked = models.ask(
        todo.select("doc_id", "table_id", "html", "prompt"), model, ["html", "prompt"],
        models.check_blocks, **calls,
    )
    parsed = F.from_json("outcome.reply", SERIALIZED)
    filled = F.struct(
        F.coalesce(parsed["subject_core_entities_list"], F.array().cast("array<string>"))
        .alias("subject_core_entities_list"),
        F.coalesce(parsed["relevant_headers_list"], F.array().cast("array<string>"))
        .alias("relevant_headers_list"),
        parsed["information_blocks"].alias("information_blocks"),
    ).cast(SERIALIZED)
    replies = asked.select(
        "doc_id", "table_id", F.when(F.col("outcome.error").isNull(), filled).alias("_new"),
        F.col("outcome.error").alias("error"),
    )
    return tables.join(replies, ["doc_id", "table_id"], "left").withColumn(
        "serialized", F.coalesce("serialized", "_new")
    ).drop("_new")


def information_blocks(serialized: Column) -> Column:
    """Block texts; null for a table that was never serialized."""
    return F.transform(serialized["information_blocks"], lambda b: b["information_block"])


# ---- pictures ------------------------------------------------------------------------------


def picture_class(reply: Column) -> tuple[Column, Column]:
    """(type, HAS_DATA or NO_DATA) from the two-line reply of the classifier."""
    kind = truthy(F.regexp_extract(reply, r"(?iU)TYPE:\s*\**\s*(\S+)", 1))
    data = F.upper(F.regexp_extract(reply, r"(?iU)DATA:\s*\**\s*(\S+)", 1))
    return (
        F.coalesce(F.lower(kind), F.lit("other")),
        F.when(F.contains(data, F.lit("HAS")), "HAS_DATA").otherwise("NO_DATA"),
    )


def _check_text(reply: dict, request: dict) -> None:
    if not str(reply.get("text") or "").strip():
        raise ValueError("empty reply")


def read_pictures(
    elements: DataFrame, docs: DataFrame, model: models.Model, limit: int | None = None, **calls
) -> DataFrame:
    """Fill ``vl`` of the pictures that lack it: classify all, read those with data.

    ``elements.img`` names the image of a picture.
    """
    todo = stages.pending_pictures(elements, limit).select("doc_id", "idx", "page", "text", "img")
    first = models.ask(
        todo.withColumns({"image": F.col("img"), "stage": F.lit("classify")}), model,
        ["image", "stage"], _check_text, out="seen", **calls,
    )
    kind, data = picture_class(F.get_json_object("seen.reply", "$.text"))
    classed = first.withColumns({"_type": kind, "_data": data})
    none = F.lit("(none)")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Company: "), F.coalesce(truthy(F.col("company")), F.lit("the company"))),
        F.concat(F.lit("Page: "), F.col("page").cast("string")),
        F.concat(F.lit("Caption: "), F.coalesce(truthy(normalize_text(F.col("text"))), none)),
        F.concat(F.lit("Before: "), F.coalesce(truthy(F.col("before")), none)),
        F.concat(F.lit("After: "), F.coalesce(truthy(F.col("after")), none)),
    )
    with_data = (
        classed.where(F.col("seen.error").isNull() & (F.col("_data") == "HAS_DATA"))
        .join(picture_context(elements), ["doc_id", "idx"], "left")
        .join(docs.select("doc_id", "company"), "doc_id", "left")
        .select("doc_id", "idx", "image", F.lit("read").alias("stage"), prompt.alias("prompt"))
    )
    second = models.ask(
        with_data, model, ["image", "stage", "prompt"], _check_text, out="reading", **calls
    ).select("doc_id", "idx", "reading")
    done = F.col("seen.error").isNull() & (
        (F.col("_data") == "NO_DATA") | F.col("reading.error").isNull()
    )
    reading = F.struct(
        F.col("_type").alias("type"), F.col("_data").alias("data"),
        F.coalesce(strip(F.get_json_object("reading.reply", "$.text")), F.lit("")).alias("text"),
        F.col("img"),
    )
    replies = classed.join(second, ["doc_id", "idx"], "left").select(
        "doc_id", "idx", F.when(done, reading).alias("_new")
    )
    return elements.join(replies, ["doc_id", "idx"], "left").withColumn(
        "vl", F.coalesce("vl", "_new")
    ).drop("_new")


# ---- prose ------------------------------------------------------------------------------------


def rewrite_chunks(
    chunks: DataFrame, model: models.Model, model_name: str, retries: int = 3, **calls
) -> DataFrame:
    """Model rewriting of prose chunks that keeps every number of the original.

    A rewrite that is empty or loses a number is refused without another try; a
    failed call is tried again.  Both leave the text as it was.
    """
    if "transform" not in chunks.columns:
        chunks = chunks.withColumn(
            "transform", F.lit(None).cast("struct<status:string,model:string,reason:string>")
        )
    if "original_text" not in chunks.columns:
        chunks = chunks.withColumn("original_text", F.lit(None).cast("string"))
    around = adjacent_prose(chunks).withColumn(
        "prompt",
        F.concat_ws(
            "\n\n", F.concat(F.lit("Text before:\n"), "previous"),
            F.concat(F.lit("Text to clean:\n"), F.coalesce("text", F.lit(""))),
            F.concat(F.lit("Text after:\n"), "following"),
        ),
    )
    asked = models.ask(
        stages.pending_chunks(around).select("doc_id", "chunk_id", "text", "prompt"),
        model, ["text", "prompt"], models.check_rewrite, retries=retries, **calls,
    )
    new = F.get_json_object("outcome.reply", "$.transformed_text")
    refused = numeric_conservation(F.col("text"), new)
    failed = F.col("outcome.error").isNotNull()
    status = F.when(failed, "failed").when(refused.isNotNull(), "validation_failed").otherwise(
        "transformed"
    )
    replies = asked.select(
        "doc_id", "chunk_id", F.when(~failed & refused.isNull(), strip(new)).alias("_text"),
        F.struct(
            status.alias("status"), F.lit(model_name).alias("model"),
            F.coalesce(F.col("outcome.error"), refused).alias("reason"),
        ).alias("_transform"),
    )
    changed = F.col("_text").isNotNull()
    return (
        chunks.join(replies, ["doc_id", "chunk_id"], "left")
        .withColumns({
            "original_text": F.when(changed, F.col("text")).otherwise(F.col("original_text")),
            "length_tokens": F.when(changed, token_count(F.col("_text")))
            .otherwise(F.col("length_tokens")),
            "text": F.coalesce("_text", "text"),
            "transform": F.coalesce("_transform", "transform"),
        })
        .drop("_text", "_transform")
    )


def transform_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document and rewriting status."""
    return chunks.where(F.col("transform").isNotNull()).groupBy(
        "doc_id", F.col("transform.status").alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- embedding ----------------------------------------------------------------------------------


def embed_chunks(
    chunks: DataFrame, embedder, batch_size: int = 32, budget: int = 3200, retries: int = 3,
    dims: int | None = None,
) -> DataFrame:
    """Unit vectors of the chunks, one model call per packed batch.

    Long texts are cut for the model only.  A batch whose reply has the wrong
    number or size of vectors is tried again; after the last try its rows carry the
    error and no vector.  ``dims`` is the size every vector must have; without it,
    ``embedded_documents`` refuses documents whose vectors differ from most.
    """
    capped = chunks.select(
        "doc_id", "chunk_id", token_truncate(F.col("text"), EMBED_TOKEN_CAP).alias("_text"),
        F.least("length_tokens", F.lit(EMBED_TOKEN_CAP)).alias("length_tokens"),
    )
    starts = embedding_batches(capped, batch_size=batch_size, budget=budget)
    batches = (
        capped.drop("length_tokens").join(shuffled(starts), ["doc_id", "chunk_id"])
        .groupBy("doc_id", "batch_start")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_id", "_text"))).alias("rows"))
        .select(
            "doc_id", F.transform("rows", lambda r: r["chunk_id"]).alias("ids"),
            F.transform("rows", lambda r: r["_text"]).alias("texts"),
        )
    )

    def vectors_of(texts: list[str]) -> tuple[list, str | None]:
        problem = None
        for _ in range(retries):
            try:
                got = [v for _, v in sorted(embedder.embed(texts), key=lambda p: p[0])]
                sizes = {len(v) for v in got}
                if len(got) != len(texts) or len(sizes) != 1 or dims not in (None, *sizes):
                    raise ValueError(f"{len(got)} vectors of sizes {sorted(sizes)} for {len(texts)} texts")
                return got, None
            except Exception as e:  # noqa: BLE001 - tried again, then reported with the rows
                problem = f"{type(e).__name__}: {e}"
        return [None] * len(texts), problem

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frame_slices(frames, ["texts"]):
            got = [vectors_of(list(t)) for t in pdf["texts"]]
            yield pdf[["doc_id", "ids"]].assign(
                vectors=[v for v, _ in got], error=[e for _, e in got]
            )

    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    raw = batches.mapInPandas(
        embed,
        f"doc_id {types['doc_id']}, ids array<{types['chunk_id']}>, "
        "vectors array<array<double>>, error string",
    )
    return stage(
        raw.select("doc_id", "error", F.inline(F.arrays_zip("ids", "vectors"))).select(
            "doc_id", F.col("ids").alias("chunk_id"),
            l2_normalize(F.col("vectors")).alias("embedding"), "error",
        ),
        "vectors",
    )


def embedded_documents(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors of complete documents, failed documents with a reason).

    One failed batch leaves its whole document out of the index, and so does a vector
    whose size is not the index's commonest (the larger of equally common ones).
    """
    size = F.size("embedding")
    sizes = embeddings.where(F.col("error").isNull()).groupBy(size.alias("dims")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max_by("dims", F.struct("n", "dims"))).scalar()
    odd = F.concat(F.lit("ValueError: a vector of size "), size.cast("string"))
    failed = embeddings.withColumn(
        "error", F.coalesce("error", F.when(size != usual, odd))
    ).where(F.col("error").isNotNull()).groupBy("doc_id").agg(F.min("error").alias("error"))
    return embeddings.join(failed.select("doc_id"), "doc_id", "left_anti").drop("error"), failed


def embed_texts(df: DataFrame, text: str, embedder, out: str = "embedding", retries: int = 3) -> DataFrame:
    """Unit vectors of single texts such as questions, and ``<out>_error`` where there is none.

    A batch is embedded in one call. If that fails, or the number or size of the vectors is
    wrong, its texts are embedded one by one, each tried ``retries`` times, so that one text
    costs no other its vector. The result is a stage table.
    """

    def vectors_of(texts: list[str]) -> list:
        got = [v for _, v in sorted(embedder.embed(texts), key=lambda p: p[0])]
        if len(got) != len(texts) or len({len(v) for v in got}) != 1:
            raise ValueError(f"{len(got)} vectors of sizes {sorted({len(v) for v in got})} for {len(texts)} texts")
        return got

    def single(one: str) -> tuple:
        problem = None
        for _ in range(retries):
            try:
                return vectors_of([one])[0], None
            except Exception as e:  # noqa: BLE001 - tried again, then reported with the row
                problem = f"{type(e).__name__}: {e}"
        return None, problem

    @F.pandas_udf("vector array<double>, error string")
    def embed(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        try:
            rows = [(v, None) for v in vectors_of(texts)] if texts else []
        except Exception:  # noqa: BLE001 - one text must not fail the others
            rows = [single(t) for t in texts]
        return pd.DataFrame(rows, columns=["vector", "error"])

    got = df.withColumn("_got", embed(F.col(text)))
    return stage(
        got.select(*df.columns, l2_normalize(F.col("_got.vector")).alias(out), F.col("_got.error").alias(f"{out}_error")), "text-vectors"
    )
