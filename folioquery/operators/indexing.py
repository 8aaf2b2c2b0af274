"""The report index on disk: lexical rows, vectors and a meta row per report.

Every run appends one batch and never touches earlier ones. Its rows lie in folders by hash
bucket of the report, in files of at most FILE_CHUNKS chunks that tasks write piece by piece
of a report, so that a huge report is many files and many tasks. The snapshot, a table of the current batch of
every indexed report, is published last: a run that dies leaves rows that nobody reads. Who
asks for some reports reads only their buckets, and in those the row groups of their ids.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from folioquery.operators.chunking import missing_chunk_ids
from folioquery.operators.enrichment import embed_chunks, embedded_documents
from folioquery.operators.lexical import index_rows
from folioquery.sources.stages import merge_latest, read_stage, write_stage
from folioquery.sources.tables import stage

PARTS = ("lexical", "vectors", "meta")
BUCKETS = 256
#: Chunks of one file, and of one report in one task.
FILE_CHUNKS = 20_000
#: Ids of asked reports that are pushed down to the files; more are only joined.
PUSHED_IDS = 1_000


def bucket_of(doc_id: Column) -> Column:
    """The bucket of a report: the first two bytes of the MD5 digest of its id."""
    return (F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def indexed_reports(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, bucket, batch): the reports of the index with their current batch."""
    try:
        return read_stage(spark, f"{path}/snapshot")
    except AnalysisException:
        return spark.createDataFrame([], "doc_id string, bucket int, batch long")


def _reached(current: DataFrame) -> Column:
    """The folders of some indexed reports: literals, so that other folders are not even listed to tasks."""
    folders = current.select("bucket", "batch").distinct().collect()  # BUCKETS times the batches at most
    return F.col("bucket").isin([r["bucket"] for r in folders]) & F.col("batch").isin([r["batch"] for r in folders])


def asked_reports(spark: SparkSession, path: str, reports: DataFrame) -> DataFrame:
    """(doc_id, bucket, batch) of those of the reports that are indexed."""
    return stage(indexed_reports(spark, path).join(reports.select("doc_id").distinct(), "doc_id", "left_semi"), "asked-reports")


def opened_files(spark: SparkSession, path: str, part: str, current: DataFrame | None = None) -> DataFrame:
    """Files of a part that a read of some reports (else of all) opens."""
    rows = spark.read.parquet(f"{path}/{part}")
    return (rows if current is None else rows.where(_reached(current))).select(F.col("_metadata.file_path").alias("file")).distinct()


def read_index(
    spark: SparkSession, path: str, reports: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexical, vectors, meta) of the indexed reports, or of those asked for."""
    current, reached = indexed_reports(spark, path), None
    if reports is not None:
        current = asked_reports(spark, path, reports)
        reached = _reached(current)
        ids = [r["doc_id"] for r in current.select("doc_id").limit(PUSHED_IDS + 1).collect()]
        if len(ids) <= PUSHED_IDS:
            reached = reached & F.col("doc_id").isin(ids)
    out = []
    for part in PARTS:
        rows = spark.read.parquet(f"{path}/{part}")
        rows = rows if reached is None else rows.where(reached)
        out.append(rows.join(current.drop("bucket"), ["doc_id", "batch"], "left_semi").drop("batch", "bucket"))
    lexical, vectors, meta = out
    return lexical.withColumnRenamed("doc_id", "route"), vectors, meta


def _append(df: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one part of a batch."""
    piece = F.floor(F.col("chunk_id") / FILE_CHUNKS) if "chunk_id" in df.columns else F.lit(0)
    rows = df.withColumn("bucket", bucket_of(F.col("doc_id"))).withColumn("_piece", piece)
    order = ["bucket", "_piece", "doc_id", *(["chunk_id"] if "chunk_id" in df.columns else [])]
    rows.repartition("bucket", "_piece").sortWithinPartitions(*order).drop("_piece").write.mode("overwrite").partitionBy(
        "bucket"
    ).option("maxRecordsPerFile", FILE_CHUNKS).parquet(f"{path}/batch={batch}")


def update_index(
    chunks: DataFrame, path: str, embedder, model: str, fingerprints: DataFrame | None = None,
    force: bool = False, batch_size: int = 32, budget: int = 3200,
) -> DataFrame:
    """Index the reports that are not indexed yet (all with ``force``); returns a row per report.

    A report with gaps in its chunk ids, blank text or a failed embedding is
    reported and left out, so that a later run takes it up again.
    """
    spark = chunks.sparkSession
    have = indexed_reports(spark, path).select("doc_id")
    skipped = chunks.select("doc_id").distinct().join(have, "doc_id", "left_semi")
    todo = chunks
    if force:
        skipped = skipped.limit(0)
    else:
        todo = chunks.join(have, "doc_id", "left_anti")
    none = F.lit(None).cast("string").alias("error")
    skipped = skipped.select("doc_id", F.lit("skipped").alias("status"), none)
    if todo.isEmpty():
        return skipped
    broken = missing_chunk_ids(todo).select(
        "doc_id", F.lit("chunk ids are not dense or a chunk is blank").alias("error")
    )
    sound = todo.join(broken.select("doc_id"), "doc_id", "left_anti")
    vectors, unembedded = embedded_documents(
        embed_chunks(sound, embedder, batch_size=batch_size, budget=budget)
    )
    ready = sound.join(unembedded.select("doc_id"), "doc_id", "left_anti")
    batch = time.time_ns()
    rows = index_rows(ready.withColumnRenamed("doc_id", "route")).withColumnRenamed("route", "doc_id")
    shas = (
        ready.select("doc_id").distinct().withColumn("sha1", F.lit(None).cast("string"))
        if fingerprints is None else fingerprints.select("doc_id", "sha1")
    )
    meta = (
        vectors.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.first(F.size("embedding")).alias("dims"))
        .join(shas, "doc_id", "left")
        .withColumns({
            "model": F.lit(model),
            "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        })
    )
    for part, df in zip(PARTS, (rows, vectors, meta)):
        _append(df, f"{path}/{part}", batch)
    # a batch without a single report has no files to infer a schema from
    shape = StructType([meta.schema["doc_id"], StructField("bucket", IntegerType())])
    written = spark.read.schema(shape).parquet(f"{path}/meta/batch={batch}").withColumn("batch", F.lit(batch))
    if not written.isEmpty():
        write_stage(merge_latest(indexed_reports(spark, path), written, ["doc_id"]), f"{path}/snapshot")
    failed = broken.unionByName(unembedded)
    return skipped.unionByName(written.select("doc_id", F.lit("indexed").alias("status"), none)).unionByName(
        failed.select("doc_id", F.lit("failed").alias("status"), "error")
    )
