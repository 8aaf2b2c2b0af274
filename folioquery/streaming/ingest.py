"""Incremental ingestion: new files of a folder, in bounded batches, restartable."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folioquery.functions.text import stem
from folioquery.operators.ingestion import LayoutReader, PageReader, ingest
from folioquery.operators.ordered import ordinal
from folioquery.sources.tables import stage


def file_stream(spark: SparkSession, folder: str, max_files: int = 10) -> DataFrame:
    """PDF files as they appear, at most ``max_files`` to a batch."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", max_files).load(folder)
    )
    return files.select(
        F.col("path").alias("source"), stem(F.col("path")).alias("doc_id"),
        F.sha1("content").alias("sha1"), "content",
    )


class Stalled(RuntimeError):
    """Several batches in a row did not bring a single report."""


def run_ingest(
    stream: DataFrame, out: str, layout_reader: LayoutReader, page_reader: PageReader | None = None,
    metadata: DataFrame | None = None, done: Callable[[], DataFrame] | None = None, stall_limit: int | None = None,
) -> None:
    """Ingest everything available and stop.

    Each batch replaces its own partition of the result, report and ledger tables, so a
    batch that is run again after a failure leaves no duplicates; the checkpoint knows the
    files that were seen and failed files stay in the result table. The ledger counts the
    attempts of every file. With a ``stall_limit`` the run ends with ``Stalled`` when so many
    batches in a row brought no report; a later run goes on from there and counts anew.
    """
    stalled = 0

    def one(batch: DataFrame, batch_id: int) -> None:
        nonlocal stalled
        finished = done() if done else batch.select("doc_id").limit(0)
        if stall_limit is not None:
            finished = finished.select("doc_id").unionByName(ingested(batch.sparkSession, out).select("doc_id"))
        progress = _write_batch(batch, finished, out, f"batch={batch_id}", layout_reader, page_reader, metadata)
        stalled = 0 if progress else stalled + 1
        if stall_limit is not None and stalled >= stall_limit:
            raise Stalled(f"{stalled} batches without a report; the files are in {out}/ledger")

    query = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/_ledger")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _write_batch(
    files: DataFrame, finished: DataFrame, out: str, folder: str, layout_reader: LayoutReader, page_reader: PageReader | None,
    metadata: DataFrame | None,
) -> bool:
    """Ingest some files; whether any of them is a report now or was one before."""
    results, reports = ingest(files, finished, layout_reader, page_reader, metadata, out=out)
    results = stage(results, "results")
    for df, name in ((results, "results"), (reports, "reports")):
        df.write.mode("overwrite").parquet(f"{out}/{name}/{folder}")
    # the ledger comes last: a batch without one has not happened
    tried = results.select("doc_id", "source", "status", "error_code", F.current_timestamp().alias("at"))
    tried.write.mode("overwrite").parquet(f"{out}/ledger/{folder}")
    return not results.where(F.col("status").isin("accepted", "skipped")).isEmpty()


def attempts(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, source, tries, status, error_code, at): each file's attempts and what came of the last one.

    Passing over a finished file is no attempt.
    """
    schema = "doc_id string, source string, status string, error_code string, at timestamp, batch string"
    try:
        rows = spark.read.parquet(f"{out}/ledger").where("status <> 'skipped'")
    except AnalysisException:  # nothing was tried yet
        return spark.createDataFrame([], schema).select("doc_id", "source", F.lit(0).cast("long").alias("tries"), "status", "error_code", "at")
    last = F.max_by(F.struct("source", "status", "error_code", "at"), F.struct("at", (F.col("status") == "accepted")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("tries"), last.alias("l")).select("doc_id", "l.source", "tries", "l.status", "l.error_code", "l.at")


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Files that are reports."""
    return attempts(spark, out).where("status = 'accepted'")


def dead_letters(spark: SparkSession, out: str, max_tries: int = 3) -> DataFrame:
    """Files nobody will try again: rejected for their text, or failed ``max_tries`` times."""
    return attempts(spark, out).where((F.col("status") == "rejected") | ((F.col("status") == "failed") & (F.col("tries") >= max_tries)))


def _turns(open_: DataFrame, per_round: int) -> DataFrame:
    """(doc_id, _turn): the round of every open file, ``per_round`` files to a round; those tried least and longest ago first."""
    # the id holds the task's number above 33 bits of the row's: a segment is what one task of the sort has
    queue = stage(open_.orderBy("tries", "at", "doc_id").select("doc_id", F.monotonically_increasing_id().alias("_at")), "queue")
    placed = ordinal(queue, [], ["_at"], "_nth", seg_len=1 << 33)
    return stage(placed.select("doc_id", F.floor(F.col("_nth") / per_round).cast("int").alias("_turn")), "turns")


def retry_failed(
    files: DataFrame, out: str, layout_reader: LayoutReader, page_reader: PageReader | None = None,
    metadata: DataFrame | None = None, max_tries: int = 3, stall_limit: int = 3, per_round: int = 10_000,
) -> int:
    """Try failed files again, in passes over all that have tries left.

    ``files`` has the rows the stream had. A pass tries each of them once, in rounds of at most
    ``per_round``, those tried least and longest ago first. Ends when no failed file has tries
    left, or after ``stall_limit`` passes in a row without a new report. Returns the number of rounds.
    """
    spark, rounds, stalled = files.sparkSession, 0, 0

    def still_open() -> DataFrame:
        return attempts(spark, out).where((F.col("status") == "failed") & (F.col("tries") < max_tries))

    turns = _turns(still_open(), per_round)
    last = turns.agg(F.max("_turn")).first()[0]
    if last:  # the open files lie apart by round, so that a round does not read all files
        waiting = stage(files.join(turns, "doc_id"), "waiting", by=["_turn"])
    else:
        waiting = files.withColumn("_turn", F.lit(0))
    while stalled < stall_limit:
        left = stage(turns.join(still_open(), "doc_id", "left_semi"), "pass")
        todo = sorted(r[0] for r in left.select("_turn").distinct().collect())
        if not todo:
            break
        progress = False
        for turn in todo:
            chosen = left.where(F.col("_turn") == turn).select("doc_id")
            again = waiting.where(F.col("_turn") == turn).drop("_turn").join(chosen, "doc_id", "left_semi")
            progress |= _write_batch(
                again, ingested(spark, out).select("doc_id"), out, f"batch=retry-{time.time_ns()}", layout_reader, page_reader,
                metadata,
            )
            rounds += 1
        stalled = 0 if progress else stalled + 1
    return rounds


def failures(spark: SparkSession, out: str) -> DataFrame:
    """Files that did not become reports, with the reason."""
    return spark.read.parquet(f"{out}/results").where(F.col("status").isin("failed", "rejected"))
