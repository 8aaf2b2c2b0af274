"""Reports, elements and questions derived from the supplied tables.

A document is read as a report: every line is one layout-parser entry, typed by
its length, six lines to a page.  Lengths give every element type.  No document, no
line and no part of a line is left out: ``report_conservation`` counts the characters.
The rules are stated once here and once as SQL so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.text import strip
from folioquery.operators.elements import ENTRY, convert_entries
from folioquery.sources.tables import table

LINES_PER_PAGE = 6


def _entry(line: Column, seq: Column) -> Column:
    def typed(n: Column) -> Column:
        kind = (
            F.when(n <= 40, "text").when(n % 11 == 4, "table").when(n % 11 == 7, "image")
            .when(n % 11 == 9, "equation").otherwise("text")
        )
        level = F.when(n <= 14, 1).when(n <= 27, 2).when(n <= 40, 3)
        table_ = (n > 40) & (n % 11 == 4)
        image = (n > 40) & (n % 11 == 7)
        return F.struct(
            kind.alias("type"),
            F.floor(seq / LINES_PER_PAGE).cast("int").alias("page_idx"),
            F.when(~table_ & ~image, line).alias("text"),
            level.alias("text_level"),
            F.when(table_, F.array(F.substring(line, 1, 12), F.substring(line, 13, 12)))
            .alias("table_caption"),
            F.when(table_, F.concat(F.lit("<table><tr><td>"), line, F.lit("</td></tr></table>")))
            .alias("table_body"),
            F.when(image, F.array(line)).alias("image_caption"),
            F.when(image, F.concat(F.lit("img/"), seq, F.lit(".jpg"))).alias("img_path"),
        ).cast(ENTRY)

    return F.transform(F.array(F.length(strip(line))), typed)[0]


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a report: its lines as layout-parser entries."""
    return table(spark, folder, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), _entry).alias("entries")
    )


def report_elements(spark: SparkSession, folder: str) -> DataFrame:
    return convert_entries(reports(spark, folder))


def with_readings(elements: DataFrame) -> DataFrame:
    """Add the picture reading a vision stage would have left behind.

    Every picture with a caption carries data, so that no line is kept from the chunks.
    """
    has_data = F.length("text") > 0
    reading = F.struct(
        F.lit("chart").alias("type"),
        F.when(has_data, "HAS_DATA").otherwise("NO_DATA").alias("data"),
        F.when(has_data, F.concat(F.lit("Reading of "), "text")).otherwise("").alias("text"),
        F.col("img").alias("img"),
    )
    return elements.withColumn("vl", F.when(F.col("type") == "picture", reading))


def serialized_tables(elements: DataFrame) -> DataFrame:
    """Tables with one information block per sentence of the cell, as a model would return."""
    cell = F.regexp_replace("html", "</?t[a-z]+>", "")
    blocks = F.filter(F.split(cell, r"\. "), lambda b: F.length(b) > 0)
    return elements.where(F.col("type") == "table").select(
        "doc_id", "table_id", "page", "html", F.col("text").alias("caption"),
        blocks.alias("blocks"),
    )
