"""Files to reports: skip what is done, gate on text quality, parse, report per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.quality import (
    DEFAULT_SAMPLE_PAGES, DEFAULT_THRESHOLD, analyze_page_texts, check_options,
)
from folioquery.operators.elements import ENTRY, attach_company
from folioquery.operators.slices import frame_slices
from folioquery.sources.tables import stage

REJECTION = "the text layer of the document is missing or damaged"
RESULT_COLUMNS = ("source", "doc_id", "status", "message", "error_code", "quality", "output_path")


class OpenFailed(Exception):
    """The file could not be opened as a document."""


class ReadFailed(Exception):
    """A page text could not be extracted."""


PageReader = Callable[[bytes, int], list[str]]
LayoutReader = Callable[[bytes], list[dict]]


def sample_pages(files: DataFrame, reader: PageReader, n: int = DEFAULT_SAMPLE_PAGES) -> DataFrame:
    """Add the texts of the first ``n`` pages, or why there are none."""

    def one(content: bytes | None) -> tuple[list[str] | None, str | None, str | None]:
        if content is None:
            return None, "FILE_NOT_FOUND", "the file does not exist"
        try:
            pages = reader(content, n)
        except OpenFailed as e:
            return None, "PDF_OPEN_FAILED", str(e)
        except ReadFailed as e:
            return None, "TEXT_EXTRACTION_FAILED", str(e)
        except Exception as e:  # noqa: BLE001 - one file must not end the run
            return None, "QUALITY_CHECK_FAILED", f"{type(e).__name__}: {e}"
        return (pages[:n], None, None) if pages else (None, "PDF_NO_PAGES", "no pages")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frame_slices(batches, ["content"]):
            got = [one(c) for c in pdf["content"]]
            yield pdf.assign(
                pages=[g[0] for g in got], read_error=[g[1] for g in got],
                read_message=[g[2] for g in got],
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(
        read, f"{columns}, pages array<string>, read_error string, read_message string"
    )


def parse_layout(files: DataFrame, reader: LayoutReader) -> DataFrame:
    """Add the layout entries, or the error of a file that could not be parsed."""

    def one(content: bytes) -> tuple[list[dict] | None, str | None]:
        try:
            return reader(content), None
        except Exception as e:  # noqa: BLE001 - one file must not end the run
            return None, str(e)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frame_slices(batches, ["content"]):
            got = [one(c) for c in pdf["content"]]
            yield pdf.drop(columns="content").assign(
                entries=[g[0] for g in got], parse_error=[g[1] for g in got]
            )

    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content"
    )
    return files.mapInPandas(parse, f"{columns}, entries array<{ENTRY}>, parse_error string")


def ingest(
    files: DataFrame, done: DataFrame, layout_reader: LayoutReader,
    page_reader: PageReader | None = None, metadata: DataFrame | None = None,
    sample: int = DEFAULT_SAMPLE_PAGES, threshold: float = DEFAULT_THRESHOLD, out: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(results, reports) of the files (source, doc_id, sha1, content).

    Files already done are skipped before anything is read; without a page reader
    the quality gate is off.  Every file gets one result row.
    """
    check_options(sample, threshold)
    done = done.select("doc_id").distinct()
    path = F.concat(F.lit(f"{out}/"), F.col("doc_id").cast("string"))
    skipped = files.drop("content").join(done, "doc_id", "left_semi").select(
        "source", "doc_id", F.lit("skipped").alias("status"),
        F.lit("already ingested").alias("message"), path.alias("output_path"),
    )
    todo = files.join(done, "doc_id", "left_anti")
    if page_reader is not None:
        read = analyze_page_texts(
            sample_pages(todo, page_reader, sample).withColumn(
                "_pages", F.coalesce("pages", F.array().cast("array<string>"))
            ),
            "_pages", threshold,
        ).drop("_pages", "pages")
        unread = F.col("read_error").isNotNull()
        quality = F.when(
            unread,
            F.col("quality").withField("error_code", F.col("read_error"))
            .withField("reason", F.col("read_message")),
        ).otherwise(F.col("quality"))
        gated = read.withColumn("quality", quality)
        broken = F.col("read_error") == "QUALITY_CHECK_FAILED"
        verdict = F.when(F.coalesce(broken, F.lit(False)), "failed").when(
            F.col("quality.passed"), "passed"
        ).otherwise("rejected")
        gated = gated.withColumn("verdict", verdict)
    else:
        none = F.lit(None).cast(
            "struct<passed:boolean,valid_char_ratio:double,extracted_chars:bigint,"
            "recognizable_chars:bigint,sample_pages:bigint,average_chars_per_page:double,"
            "text_page_ratio:double,reason:string,error_code:string>"
        )
        gated = todo.withColumns({
            "quality": none, "verdict": F.lit("passed"), "read_message": F.lit(None).cast("string"),
        })
    gated = stage(gated, "gated")
    stopped = gated.where(F.col("verdict") != "passed")
    failed = F.col("verdict") == "failed"
    refused = stopped.select(
        "source", "doc_id", F.col("verdict").alias("status"),
        F.when(failed, F.concat(F.lit("quality check failed: "), "read_message"))
        .otherwise(F.lit(REJECTION)).alias("message"),
        F.when(failed, "QUALITY_CHECK_FAILED").otherwise("DOCUMENT_QUALITY_REJECTED")
        .alias("error_code"),
        F.when(~failed, F.col("quality")).alias("quality"),
    )
    parsed = stage(
        parse_layout(
            gated.where(F.col("verdict") == "passed")
            .select("source", "doc_id", "sha1", "quality", "content"),
            layout_reader,
        ),
        "parsed",
    )
    wrong = F.col("parse_error").isNotNull()
    tried = parsed.select(
        "source", "doc_id", F.when(wrong, "failed").otherwise("accepted").alias("status"),
        F.when(wrong, F.concat(F.lit("parsing failed: "), "parse_error")).otherwise("parsed")
        .alias("message"),
        F.when(wrong, "PDF_PARSE_FAILED").alias("error_code"), "quality",
        F.when(~wrong, path).alias("output_path"),
    )
    results = (
        skipped.unionByName(refused, allowMissingColumns=True)
        .unionByName(tried, allowMissingColumns=True)
        .select(*RESULT_COLUMNS)
    )
    reports = parsed.where(~wrong).select(
        "doc_id", F.regexp_extract("source", r"([^/]+)$", 1).alias("source_pdf"), "sha1", "entries"
    )
    if metadata is not None:
        reports = attach_company(reports, metadata)
    return results, reports
