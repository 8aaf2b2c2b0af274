"""From ranked chunks to the context of an answer: pages, spans, size limits, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import heading_markdown, normalize_text, truthy
from folioquery.operators.ordered import SEGMENT, running_sums, segment_of
from folioquery.sources.tables import shuffled, stage

MAX_CONTEXT_CHARS = 60_000
METRIC_CONTEXT_CHARS = 16_000
WINDOW = 15


def parent_pages(candidates: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole pages of the candidates, each once, in order of first appearance.

    ``candidates`` has the keys, doc_id, page and rank; ``keys`` must include what
    identifies the question.
    """
    group = [*keys, "doc_id"]
    first = candidates.groupBy(*group, "page").agg(F.min("rank").alias("_first"))
    order = Window.partitionBy(*group).orderBy("_first")
    texts = pages.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), "text")
    # entries without a page form one page of their own
    return (
        first.withColumn("page_rank", F.row_number().over(order))
        .join(shuffled(texts), (F.col("doc_id") == F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
        .select(*group, "page", "page_rank", "text")
    )


def parent_context(
    candidates: DataFrame, keys: Sequence[str], mode: str = "pages", **inputs
) -> DataFrame:
    """Parent text of ranked candidates: ``pages`` or ``els_window``."""
    if mode == "pages":
        return parent_pages(candidates, inputs["pages"], keys)
    if mode == "els_window":
        parts = element_parts(inputs["elements"], inputs["tables"])
        return window_texts(
            candidates, parts, keys, inputs.get("window", WINDOW),
            inputs.get("max_chars", MAX_CONTEXT_CHARS),
        )
    raise ValueError(f"unknown parent mode {mode!r}")


def element_parts(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, idx, part): what an element adds to a span; nothing for empty ones.

    Differs from page text on purpose: no table prefix, the picture reading
    replaces the caption, and a table without any text leaves a mark.
    """
    text = normalize_text(F.coalesce("text", F.lit("")))
    is_table = F.col("type") == "table"
    blocks = tables.select("doc_id", "table_id", F.array_join("blocks", "\n").alias("part"))
    of_tables = (
        elements.where(is_table).select("doc_id", "idx", "table_id", text.alias("text"))
        .join(blocks, ["doc_id", "table_id"], "left")
        .select(
            "doc_id", "idx",
            F.coalesce("part", truthy(F.col("text")), F.lit("[table]")).alias("part"),
        )
    )
    read = F.when(F.col("vl.data") == "HAS_DATA", truthy(F.col("vl.text")))
    others = elements.where(~is_table).withColumn("text", text).select(
        "doc_id", "idx",
        F.when(F.col("type") == "picture", F.coalesce(read, truthy(F.col("text"))))
        .when(
            (F.col("type") == "heading") & (F.col("text") != ""),
            heading_markdown(F.col("level"), F.col("text")),
        )
        .otherwise(truthy(F.col("text"))).alias("part"),
    )
    return of_tables.unionByName(others.where(F.col("part").isNotNull()))


def merged_spans(
    candidates: DataFrame, keys: Sequence[str], windows: Sequence[int] = (0,)
) -> DataFrame:
    """Element ranges widened by each window, touching ranges merged, per question and document."""
    group = [*keys, "doc_id", "window"]
    wide = candidates.select(
        *keys, "doc_id", "els_start", "els_end",
        F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"),
    ).select(
        *group, F.greatest(F.lit(0), F.col("els_start") - F.col("window")).alias("_s"),
        (F.col("els_end") + F.col("window")).alias("_e"),
    )
    order = Window.partitionBy(*group).orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = wide.withColumn("_new", (F.col("_s") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = islands.withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return islands.groupBy(*group, "_island").agg(
        F.min("_s").alias("span_start"), F.max("_e").alias("span_end")
    ).drop("_island")


def rows_in_spans(spans: DataFrame, rows: DataFrame, seg_len: int = SEGMENT) -> DataFrame:
    """Join rows whose ``idx`` lies in [span_start, span_end), by document and segment."""
    pieces = spans.withColumn(
        "_seg",
        F.explode(F.sequence(
            segment_of("span_start", seg_len), segment_of(F.col("span_end") - 1, seg_len)
        )),
    )
    return pieces.join(
        rows.withColumn("_seg", segment_of("idx", seg_len)), ["doc_id", "_seg"]
    ).where(
        (F.col("idx") >= F.col("span_start")) & (F.col("idx") < F.col("span_end"))
    ).drop("_seg")


def halving(window: int) -> list[int]:
    steps = [window]
    while steps[-1] > 0:
        steps.append(steps[-1] // 2)
    return steps


def window_texts(
    candidates: DataFrame, parts: DataFrame, keys: Sequence[str], window: int = WINDOW,
    max_chars: int = MAX_CONTEXT_CHARS,
) -> DataFrame:
    """Span texts with the widest window, halved until the texts fit ``max_chars``.

    A window of 0 is taken whatever its size.  Sizes are added up from the part
    lengths alone; text is joined only for the window that was chosen.
    """
    group = [*keys, "doc_id"]
    span = [*group, "window", "span_start", "span_end"]
    # Both are read for the sizes and again for the texts.
    spans = stage(merged_spans(candidates, keys, halving(window)), "spans")
    parts = stage(parts, "parts")
    lengths = parts.select("doc_id", "idx", F.length("part").alias("_len"))
    sizes = rows_in_spans(spans, lengths).groupBy(*span).agg(
        (F.sum("_len") + 2 * (F.count(F.lit(1)) - 1)).alias("_chars")
    )
    totals = spans.join(sizes, span, "left").groupBy(*group, "window").agg(
        F.sum(F.coalesce("_chars", F.lit(0))).alias("_total")
    )
    chosen = totals.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("_total") <= max_chars, F.col("window"))), F.lit(0))
        .alias("window")
    )
    picked = spans.join(chosen, [*group, "window"])
    texts = rows_in_spans(picked, parts).groupBy(*span).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda p: p["part"]
            ),
            "\n\n",
        ).alias("text")
    )
    return picked.join(texts, span, "left").withColumn("text", F.coalesce("text", F.lit("")))


def keep_prefix(
    df: DataFrame, keys: Sequence[str], order: str, length: Column,
    cap: int = MAX_CONTEXT_CHARS, keep_first: bool = False,
) -> DataFrame:
    """Rows in order while their summed length stays within ``cap``.

    Lengths are not negative, so the first overflow ends the prefix.  With
    ``keep_first`` a first row that alone is over the cap is kept by itself.
    """
    out = running_sums(df, keys, order, {"_total": length, "_nth": F.lit(1)})
    fits = F.col("_total") <= cap
    if keep_first:
        fits = fits | (F.col("_nth") == 1)
    return out.where(fits).drop("_total", "_nth")


def valid_pages(
    cited: Column, provided: Column, min_pages: int = 2, max_pages: int = 8
) -> Column:
    """Cited pages that were provided, topped up in context order, cut to the maximum."""
    kept = F.filter(F.array_distinct(cited), lambda p: F.array_contains(provided, p))
    padded = F.array_distinct(F.concat(kept, provided))
    return F.slice(F.slice(padded, 1, F.greatest(F.lit(min_pages), F.size(kept))), 1, max_pages)


def references(pages: Column, sha1: Column) -> Column:
    """Citations of the valid pages; an unknown report has an empty fingerprint."""
    return F.transform(
        pages,
        lambda p: F.struct(
            F.coalesce(sha1, F.lit("")).alias("pdf_sha1"), p.alias("page_index")
        ),
    )
