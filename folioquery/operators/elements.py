"""Layout-parser entries to the element stream, with tables on the side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import basename, normalize_text, strip
from folioquery.operators.ordered import running_sums

# One layout-parser entry; a report holds an array of them in file order.
ENTRY = (
    "struct<type:string,page_idx:int,text:string,text_level:int,table_caption:array<string>,"
    "table_body:string,image_caption:array<string>,img_path:string>"
)


def _caption(parts: Column) -> Column:
    return strip(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), " "))


def _element(e: Column) -> Column:
    kind = F.coalesce(e["type"], F.lit(""))
    level = F.coalesce(e["text_level"], F.lit(0))
    return F.struct(
        (e["page_idx"] + 1).alias("page"),
        F.when((kind == "text") & (level != 0), "heading")
        .when(kind == "text", "paragraph")
        .when(kind == "image", "picture")
        .when(kind == "", "unknown")
        .otherwise(kind).alias("type"),
        F.when(kind == "table", _caption(e["table_caption"]))
        .when(kind == "image", _caption(e["image_caption"]))
        .otherwise(strip(F.coalesce(e["text"], F.lit("")))).alias("text"),
        F.when(kind == "text", level).otherwise(0).alias("level"),
        F.when(kind == "table", F.coalesce(e["table_body"], F.lit(""))).alias("html"),
        F.when(kind == "image", F.coalesce(e["img_path"], F.lit(""))).alias("img"),
    )


def convert_entries(reports: DataFrame) -> DataFrame:
    """(doc_id, entries) to one row per kept element, in the row and without a shuffle.

    ``idx`` is the dense position of the element in its document and the k-th
    table of a document gets the id ``t<k>``.
    """
    useful = F.filter("entries", lambda e: F.coalesce(e["type"], F.lit("")) != "discarded")
    kept = F.filter(
        F.transform(useful, _element),
        lambda e: e["type"].isin("table", "picture") | (e["text"] != ""),
    )
    table_at = F.filter(
        F.transform("_kept", lambda e, i: F.when(e["type"] == "table", i)),
        lambda i: i.isNotNull(),
    )
    named = F.transform(
        "_kept",
        lambda e, i: F.struct(
            *[e[n].alias(n) for n in ("page", "type", "text", "level")],
            F.when(
                e["type"] == "table", F.concat(F.lit("t"), F.array_position("_tables", i) - 1)
            ).alias("table_id"),
            e["html"].alias("html"), e["img"].alias("img"),
        ),
    )
    return (
        reports.select("doc_id", kept.alias("_kept"))
        .withColumn("_tables", table_at)
        .select("doc_id", F.posexplode(named).alias("idx", "e"))
        .select("doc_id", F.col("idx").cast("long").alias("idx"), "e.*")
    )


def tables_of(elements: DataFrame) -> DataFrame:
    """The table side of converted entries."""
    return elements.where(F.col("type") == "table").select(
        "doc_id", "table_id", "page", "html", F.col("text").alias("caption")
    )


def document_stats(elements: DataFrame) -> DataFrame:
    """Counts per document; pages are the highest page an element was kept on."""
    return elements.groupBy("doc_id").agg(
        F.coalesce(F.max("page"), F.lit(0)).alias("num_pages"),
        F.count(F.lit(1)).alias("num_elements"),
        F.count_if(F.col("type") == "table").alias("num_tables"),
        F.count_if(F.col("type") == "picture").alias("num_pictures"),
    )


def attach_company(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left lookup of the company by file name; of rows that name one file the last counts, unknown files stay.

    ``metadata`` has filename, company and csv_ord, its row order.
    """
    lookup = metadata.groupBy(basename(F.col("filename")).alias("_file")).agg(
        F.max_by("company", "csv_ord").alias("company")
    )
    return (
        docs.withColumn("_file", basename(F.col("source_pdf")))
        .join(lookup, "_file", "left")
        .drop("_file")
    )


def normalize_elements(elements: DataFrame) -> DataFrame:
    return elements.withColumn("text", normalize_text(F.col("text")))


def normalize_tables(tables: DataFrame) -> DataFrame:
    return tables.withColumns({c: normalize_text(F.col(c)) for c in ("html", "caption")})


def align_pictures(elements: DataFrame, raw_images: DataFrame) -> DataFrame:
    """k-th picture element with the k-th raw image entry.

    A document whose counts differ is returned as failed rows without images.
    ``raw_images`` has doc_id, seq, img_path.
    """
    pics = running_sums(
        elements.where(F.col("type") == "picture").select("doc_id", "idx", "page"),
        ["doc_id"], "idx", {"_k": F.lit(1)},
    )
    imgs = running_sums(
        raw_images.select("doc_id", "seq", F.col("img_path").alias("_path")),
        ["doc_id"], "seq", {"_k": F.lit(1)},
    ).drop("seq")
    n_pics = pics.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_np"))
    n_imgs = imgs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_ni"))
    counts = n_pics.join(n_imgs, "doc_id", "left").withColumn(
        "aligned", F.col("_np") == F.coalesce("_ni", F.lit(0))
    )
    return (
        pics.join(imgs, ["doc_id", "_k"], "left")
        .join(counts.select("doc_id", "aligned"), "doc_id")
        .select("doc_id", "idx", "page", F.when(F.col("aligned"), F.col("_path")).alias("img"),
                "aligned")
    )


def is_large_table(html: Column, max_rows: int = 50, max_chars: int = 12_000) -> Column:
    """Whether a table is too large to be rewritten row by row."""
    return (F.regexp_count(html, F.lit("<tr>")) > max_rows) | (F.length(html) > max_chars)
