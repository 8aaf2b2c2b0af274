"""Registered queries: quality, normalization, elements, sections, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions import text as X
from folioquery.functions.text import WHITESPACE_CLASS
from folioquery.functions.quality import analyze_page_texts
from folioquery.operators import chunking as C
from folioquery.operators import elements as E
from folioquery.operators.elements import ENTRY, convert_entries
from folioquery.plans import derived as D
from folioquery.plans import sqltext as S
from folioquery.plans.registry import query
from folioquery.sources.tables import stage, table

PAGES_OF_LINES = f"""
{S.LINES},
page_rows AS (
  SELECT doc_id, seq // {D.LINES_PER_PAGE} AS page, string_agg(line, {S.NL} ORDER BY seq) AS text
  FROM lines GROUP BY 1, 2
),
counted AS (
  SELECT doc_id, {S.extracted('text')} AS e, {S.recognizable('text')} AS r FROM page_rows
),
sums AS (
  SELECT doc_id, sum(e)::BIGINT AS e, sum(r)::BIGINT AS r, count(*) AS p,
    count(*) FILTER (r > 0) AS t
  FROM counted GROUP BY doc_id
)"""


def quality_of_documents(spark, folder):
    """Pages of six lines each, measured inside the row."""
    lines = F.split("text", "\n")
    n_pages = F.ceil(F.size("lines") / D.LINES_PER_PAGE).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), n_pages - 1),
        lambda i: F.array_join(F.slice("lines", i * D.LINES_PER_PAGE + 1, D.LINES_PER_PAGE), "\n"),
    )
    docs = table(spark, folder, "documents").select("doc_id", "source", lines.alias("lines"))
    return analyze_page_texts(docs.select("doc_id", "source", pages.alias("pages")), "pages")


@query("quality_gate_docs", f"""
WITH {PAGES_OF_LINES}
SELECT doc_id, r > 0 AND r::DOUBLE / e >= 0.8 AS passed,
  round(CASE WHEN e > 0 THEN r::DOUBLE / e ELSE 0 END, 6) AS valid_char_ratio,
  e AS extracted_chars, r AS recognizable_chars, p AS sample_pages,
  round(r::DOUBLE / p, 6) AS average_chars_per_page, round(t::DOUBLE / p, 6) AS text_page_ratio,
  CASE WHEN r = 0 THEN 'NO_RECOGNIZABLE_TEXT' WHEN r::DOUBLE / e < 0.8 THEN 'LOW_VALID_CHAR_RATIO' END
    AS error_code
FROM sums""")
def quality_gate_docs(spark, folder):
    q = quality_of_documents(spark, folder)
    ratios = ("valid_char_ratio", "average_chars_per_page", "text_page_ratio")
    return q.select("doc_id", *[
        (F.round(f"quality.{c}", 6) if c in ratios else F.col(f"quality.{c}")).alias(c)
        for c in ("passed", "valid_char_ratio", "extracted_chars", "recognizable_chars",
                  "sample_pages", "average_chars_per_page", "text_page_ratio", "error_code")
    ])


@query("quality_by_source", f"""
WITH {PAGES_OF_LINES}
SELECT source, count(*) AS n_docs,
  count(*) FILTER (r > 0 AND r::DOUBLE / e >= 0.8) AS n_passed,
  sum(e)::BIGINT AS extracted_chars, sum(r)::BIGINT AS recognizable_chars
FROM sums JOIN documents USING (doc_id) GROUP BY source""")
def quality_by_source(spark, folder):
    return quality_of_documents(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("quality.passed").alias("n_passed"),
        F.sum("quality.extracted_chars").alias("extracted_chars"),
        F.sum("quality.recognizable_chars").alias("recognizable_chars"),
    )


@query("normalize_documents", f"""
SELECT doc_id, {S.normalize(S.normalize('text'))} AS text FROM documents""")
def normalize_documents(spark, folder):
    """Applied twice, as every text passes it at least twice on its way to a chunk."""
    once = table(spark, folder, "documents").select(
        "doc_id", X.normalize_text(F.col("text")).alias("text")
    )
    return once.withColumn("text", X.normalize_text(F.col("text")))


@query("token_counts", f"""
SELECT doc_id, {S.tokens('text')} AS n_tokens, len({S.lexical('text')}) AS n_terms,
  len({S.numbers('text')}) AS n_numbers,
  replace(substr(text, 1, 90), {S.NL}, ' ') || CASE WHEN length(text) > 90 THEN '…' ELSE '' END AS snippet
FROM documents""")
def token_counts(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        X.token_count(F.col("text")).alias("n_tokens"),
        F.size(X.lexical_tokens(F.col("text"))).alias("n_terms"),
        F.size(X.numeric_tokens(F.col("text"))).alias("n_numbers"),
        X.snippet(F.col("text")).alias("snippet"),
    )


@query("report_elements", f"""
WITH {S.ELEMENTS}
SELECT doc_id, idx, page, type, text, level, table_id, html, img FROM elements""")
def report_elements(spark, folder):
    return D.report_elements(spark, folder)


@query("report_stats", f"""
WITH {S.ELEMENTS}
SELECT doc_id, max(page) AS num_pages, count(*) AS num_elements,
  count(*) FILTER (type = 'table') AS num_tables, count(*) FILTER (type = 'picture') AS num_pictures
FROM elements GROUP BY doc_id""")
def report_stats(spark, folder):
    return E.document_stats(D.report_elements(spark, folder))


@query("large_tables", f"""
WITH {S.ELEMENTS}
SELECT doc_id, table_id, {S.normalize('html')} AS html, text AS caption,
  len(regexp_extract_all(html, '<tr>')) > 50 OR length(html) > 12000 AS is_large
FROM normal WHERE type = 'table'""")
def large_tables(spark, folder):
    """Normalized table side, with the flag for tables too large to rewrite row by row."""
    tables = E.normalize_tables(E.tables_of(D.report_elements(spark, folder)))
    return tables.select(
        "doc_id", "table_id", "html", "caption", E.is_large_table(F.col("html")).alias("is_large")
    )


@query("picture_alignment", f"""
WITH {S.ELEMENTS}
SELECT doc_id, idx, page, img, true AS aligned FROM elements WHERE type = 'picture'""")
def picture_alignment(spark, folder):
    """Picture elements joined by position with the raw image entries."""
    reports = D.reports(spark, folder)
    images = reports.select("doc_id", F.posexplode("entries").alias("seq", "e")).where(
        F.col("e.type") == "image"
    ).select("doc_id", "seq", F.col("e.img_path").alias("img_path"))
    return E.align_pictures(E.convert_entries(reports), images)


@query("heading_breadcrumbs", f"""
WITH {S.CRUMBS} SELECT doc_id, idx, crumb FROM prose""")
def heading_breadcrumbs(spark, folder):
    return C.heading_breadcrumbs(D.report_elements(spark, folder))


def parsed_elements(spark, folder):
    """The elements as a stage table: chunks, units and tables all read them."""
    return stage(D.with_readings(D.report_elements(spark, folder)), "elements")


def document_chunks(spark, folder, table_source="serialized"):
    elements = parsed_elements(spark, folder)
    return C.split_documents(elements, D.serialized_tables(elements), table_source=table_source)


@query("report_chunks", f"""
WITH {S.CHUNKS}
SELECT doc_id, chunk_id, type, page, text, els_start, els_end, table_id, length_tokens FROM chunks""")
def report_chunks(spark, folder):
    return document_chunks(spark, folder)[0].drop("img")


_SERIALIZED_BODY = S.CHUNKS[S.CHUNKS.index("    CASE WHEN blocks <> ''"):S.CHUNKS.index(" AS unit, table_id")]
_HTML_BODY = f"""
    CASE WHEN caption_raw <> '' THEN 'Table: ' || caption_raw || {S.NL} ELSE '' END || html"""


assert _SERIALIZED_BODY in S.CHUNKS


@query("report_chunks_html", f"""
WITH {S.CHUNKS.replace(_SERIALIZED_BODY, _HTML_BODY)}
SELECT doc_id, chunk_id, type, page, text, els_start, els_end, table_id, length_tokens FROM chunks""")
def report_chunks_html(spark, folder):
    """The other arm of the table comparison: tables as HTML."""
    return document_chunks(spark, folder, "html")[0].drop("img")


@query("page_texts", f"""
WITH {S.CHUNKS} SELECT doc_id, page, text FROM page_texts""")
def page_texts(spark, folder):
    return document_chunks_pages(spark, folder)


def document_chunks_pages(spark, folder):
    elements = parsed_elements(spark, folder)
    return C.page_texts(elements, C.unit_bodies(elements, D.serialized_tables(elements)))


@query("chunk_token_percentiles", f"""
WITH {S.CHUNKS},
sorted AS (
  SELECT doc_id, type, length_tokens,
    row_number() OVER (PARTITION BY doc_id ORDER BY length_tokens) - 1 AS pos,
    count(*) OVER (PARTITION BY doc_id) AS n FROM chunks
)
SELECT doc_id, max(n) AS n_chunks, count(*) FILTER (type = 'content') AS n_content,
  count(*) FILTER (type = 'serialized_table') AS n_serialized_table,
  count(*) FILTER (type = 'serialized_image') AS n_serialized_image,
  max(length_tokens) FILTER (pos = n // 2) AS p50,
  max(length_tokens) FILTER (pos = floor(n * 0.95)) AS p95, max(length_tokens) AS max_tokens
FROM sorted GROUP BY doc_id""")
def chunk_token_percentiles(spark, folder):
    return C.chunk_stats(document_chunks(spark, folder)[0])


# ---- nothing is lost ------------------------------------------------------------------

@query("report_conservation", f"""
WITH {S.ENTRIES},
ink AS (SELECT doc_id, rtype, {S.extracted('line')} AS n FROM entries)
SELECT doc_id, sum(n)::BIGINT AS chars_in, sum(n)::BIGINT AS chars_out,
  coalesce(sum(n) FILTER (rtype = 'image'), 0)::BIGINT AS picture_chars_in_chunks
FROM ink GROUP BY doc_id""")
def report_conservation(spark, folder):
    """Characters of every report that are not white space: in its entries, its elements, and in its chunks of pictures."""
    blank = F.lit(f"[{WHITESPACE_CLASS}]")

    def ink(c):
        return F.length(F.regexp_replace(c, blank, F.lit("")))

    before = D.reports(spark, folder).select(
        "doc_id",
        F.aggregate(
            "entries", F.lit(0).cast("long"),
            lambda n, e: n + ink(F.coalesce(
                e["text"], F.regexp_replace(e["table_body"], "</?t[a-z]+>", ""), F.get(e["image_caption"], F.lit(0)),
            )),
        ).alias("chars_in"),
    )
    told = F.when(F.col("type") == "table", F.regexp_replace("html", "</?t[a-z]+>", "")).otherwise(F.col("text"))
    after = D.report_elements(spark, folder).groupBy("doc_id").agg(F.sum(ink(told)).alias("chars_out"))
    chunks, _ = document_chunks(spark, folder)
    pictures = chunks.where(F.col("type") == "serialized_image").groupBy("doc_id").agg(
        F.sum(ink(F.expr("substring(text, length('Reading of ') + 1)"))).alias("picture_chars")
    )
    return before.join(after, "doc_id", "left").join(pictures, "doc_id", "left").select(
        "doc_id", "chars_in", F.coalesce("chars_out", F.lit(0)).cast("long").alias("chars_out"),
        F.coalesce("picture_chars", F.lit(0)).cast("long").alias("picture_chars_in_chunks"),
    )


@query("discarded_entries", """
SELECT conv_id AS doc_id, count(*) AS n_entries, count(*) FILTER (turn % 3 <> 2 AND trim(text) <> '') AS n_elements
FROM conversations GROUP BY conv_id""")
def discarded_entries(spark, folder):
    """Conversations as reports whose every third turn is a running header the parser marked: it gives no element."""
    kind = F.when(F.col("turn") % 3 == 2, "discarded").otherwise("text")
    entry = F.struct(
        F.col("turn"), F.struct(
            kind.alias("type"), F.lit(0).alias("page_idx"), F.col("text"), F.lit(None).cast("int").alias("text_level"),
            F.lit(None).cast("array<string>").alias("table_caption"), F.lit(None).cast("string").alias("table_body"),
            F.lit(None).cast("array<string>").alias("image_caption"), F.lit(None).cast("string").alias("img_path"),
        ).cast(ENTRY).alias("entry"),
    )
    talks = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("turns")
    ).select("doc_id", F.transform("turns", lambda t: t["entry"]).alias("entries"))
    elements = convert_entries(talks).groupBy("doc_id").agg(F.count("*").alias("n_elements"))
    return talks.select("doc_id", F.size("entries").cast("long").alias("n_entries")).join(
        elements, "doc_id", "left"
    ).select("doc_id", "n_entries", F.coalesce("n_elements", F.lit(0)).alias("n_elements"))
