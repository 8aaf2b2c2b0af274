"""Readers and writers of the stage files, and what a rerun still has to do."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.text import basename, stem, truthy
from folioquery.operators.elements import ENTRY

# ---- readers ----------------------------------------------------------------------


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, doc_id, sha1, content) of the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(
        F.col("path").alias("source"), stem(F.col("path")).alias("doc_id"),
        F.sha1("content").alias("sha1"), "content",
    )


def layout_files(spark: SparkSession, folder: str) -> DataFrame:
    """Layout-parser output, one JSON list per report; the newest file of a report wins."""
    files = (
        spark.read.option("pathGlobFilter", "*_content_list.json")
        .option("recursiveFileLookup", "true").format("binaryFile").load(folder)
    )
    rows = files.select(
        F.regexp_replace(basename(F.col("path")), "_content_list\\.json$", "").alias("doc_id"),
        F.struct("modificationTime", "path", "content").alias("f"),
    )
    newest = rows.groupBy("doc_id").agg(F.max_by("f.content", "f").alias("content"))
    return newest.select(
        "doc_id",
        F.from_json(F.col("content").cast("string"), f"array<{ENTRY}>").alias("entries"),
    )


def company_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The company table; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.withColumn("csv_ord", F.monotonically_increasing_id())


def question_fields(raw: DataFrame) -> DataFrame:
    """Question and kind of either spelling; empty strings fall through like nulls."""
    def field(name: str):
        return truthy(F.col(name)) if name in raw.columns else F.lit(None).cast("string")

    rest = [c for c in raw.columns if c not in ("text", "question", "kind", "schema")]
    last = F.col("question") if "question" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        *rest, F.coalesce(field("text"), last).alias("question"),
        F.coalesce(field("kind"), field("schema"), F.lit("name")).alias("kind"),
    )


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions of a JSON list in file order; ``limit`` keeps the first ones."""
    shape = "text string, question string, kind string, schema string"
    items = spark.read.option("wholetext", True).text(path).select(
        F.posexplode(F.from_json("value", f"array<struct<{shape.replace(' string', ':string')}>>"))
        .alias("question_id", "q")
    )
    rows = question_fields(items.select("question_id", "q.*"))
    return rows.where(F.col("question_id") < limit) if limit is not None else rows


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stage folder with one JSON document per report."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).select(
        # the name is percent-encoded; a plus sign in it is not a blank
        "*", stem(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))).alias("doc_id")
    )


# ---- resume -------------------------------------------------------------------------


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def answered(answers: DataFrame) -> DataFrame:
    """Questions that count as answered; failed rows are tried again."""
    return answers.where(F.col("error").isNull()).select("question").distinct()


def pending_tables(tables: DataFrame, limit: int | None = None) -> DataFrame:
    """Tables without a serialized form, at most ``limit`` per report."""
    return _first_per_document(
        tables.where(F.col("serialized").isNull()),
        F.substring("table_id", 2, 20).cast("long"), limit,
    )


def pending_pictures(elements: DataFrame, limit: int | None = None) -> DataFrame:
    """Pictures that were not read yet."""
    rows = elements.where((F.col("type") == "picture") & F.col("vl").isNull())
    return _first_per_document(rows, F.col("idx"), limit)


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Prose that was not rewritten; failed and refused chunks are tried again."""
    status = F.coalesce(F.col("transform.status"), F.lit(""))
    return chunks.where((F.col("type") == "content") & (status != "transformed"))


def _first_per_document(df: DataFrame, order, limit: int | None) -> DataFrame:
    from pyspark.sql import Window

    if limit is None:
        return df
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows kept, replaced where the new run has the key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


# ---- writers ---------------------------------------------------------------------------


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add a version of a stage table and make it the current one.

    Versions lie in folders of their own.  The one-row file that names the current one
    is written last and never in place of another, so a failed write leaves the version
    before it in force.
    """
    version = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/versions/{version}")
    now = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    now.coalesce(1).write.mode("append").parquet(f"{path}/current")


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a stage table."""
    version = spark.read.parquet(f"{path}/current").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{path}/versions/{version}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
