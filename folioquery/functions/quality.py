"""Text-layer quality metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import UNRECOGNIZABLE_PATTERN, WHITESPACE_CLASS

DEFAULT_SAMPLE_PAGES = 5
DEFAULT_THRESHOLD = 0.80


def check_options(sample_pages: int, threshold: float) -> None:
    if sample_pages <= 0:
        raise ValueError("sample_pages must be positive")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")


def extracted_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{WHITESPACE_CLASS}]", "")).cast("long")


def recognizable_chars(text: Column) -> Column:
    """Letters, numbers, punctuation and symbols other than the replacement mark."""
    return F.length(F.regexp_replace(text, UNRECOGNIZABLE_PATTERN, "")).cast("long")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def verdict(extracted, recognizable, pages, text_pages, threshold: float) -> Column:
    """Quality struct from summed page counts; a ratio equal to the threshold passes."""
    ratio = _ratio(recognizable, extracted)
    code = F.when(recognizable == 0, F.lit("NO_RECOGNIZABLE_TEXT")).when(
        ratio < threshold, F.lit("LOW_VALID_CHAR_RATIO")
    )
    reason = F.when(
        recognizable == 0,
        F.format_string("pages 1 to %d hold no letter, number or sign that can be read", pages),
    ).when(
        ratio < threshold,
        F.format_string(
            "of %d characters on pages 1 to %d only %d can be read: %.1f%%, and %.0f%% are asked for",
            extracted, pages, recognizable, ratio * 100, F.lit(threshold * 100.0),
        ),
    )
    return F.struct(
        code.isNull().alias("passed"),
        ratio.alias("valid_char_ratio"),
        extracted.alias("extracted_chars"),
        recognizable.alias("recognizable_chars"),
        pages.alias("sample_pages"),
        _ratio(recognizable, pages).alias("average_chars_per_page"),
        _ratio(text_pages, pages).alias("text_page_ratio"),
        reason.alias("reason"),
        code.alias("error_code"),
    )


def analyze_page_texts(
    df: DataFrame, pages: str, threshold: float = DEFAULT_THRESHOLD, out: str = "quality"
) -> DataFrame:
    """Add the quality struct for an array of page texts, without a shuffle."""
    check_options(1, threshold)
    counts = F.transform(
        F.col(pages),
        lambda t: F.struct(extracted_chars(t).alias("e"), recognizable_chars(t).alias("r")),
    )

    def add(acc, page):
        return F.struct(
            (acc["e"] + page["e"]).alias("e"),
            (acc["r"] + page["r"]).alias("r"),
            (acc["t"] + (page["r"] > 0).cast("long")).alias("t"),
        )

    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in "ert"])
    return (
        df.withColumn("_sums", F.aggregate(counts, zero, add))
        .withColumn(
            out,
            verdict(
                F.col("_sums.e"), F.col("_sums.r"), F.size(pages).cast("long"),
                F.col("_sums.t"), threshold,
            ),
        )
        .drop("_sums")
    )


def gate_page_rows(
    df: DataFrame,
    key: str = "doc_id",
    page: str = "page",
    text: str = "text",
    sample_pages: int | None = None,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Quality per document from one row per page; counts are summed map-side first."""
    check_options(sample_pages or 1, threshold)
    if sample_pages is not None:
        df = df.where(F.col(page) <= sample_pages)
    rows = df.select(
        key, extracted_chars(F.col(text)).alias("_e"), recognizable_chars(F.col(text)).alias("_r")
    )
    return (
        rows.groupBy(key)
        .agg(
            F.sum("_e").alias("_e"),
            F.sum("_r").alias("_r"),
            F.count(F.lit(1)).alias("_p"),
            F.sum((F.col("_r") > 0).cast("long")).alias("_t"),
        )
        .select(
            key,
            verdict(F.col("_e"), F.col("_r"), F.col("_p"), F.col("_t"), threshold).alias("quality"),
        )
    )
