"""Text around tables, pictures and chunks, as given to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import normalize_text, strip
from folioquery.operators.ordered import neighbour

ADJACENT_CHARS = 800


def _join_texts(items: Column) -> Column:
    texts = F.transform(items, lambda b: b["text"])
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n")


def table_context(elements: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, table_id, page, before, after) from the same page.

    Before: everything since the previous table.  After: up to the next table but
    for the block right before it, or the next ``reach`` blocks when no table
    follows.  A table without a page has no context.
    """
    page = Window.partitionBy("doc_id", "page")
    is_table = (F.col("type") == "table").cast("int")
    placed = elements.where(F.col("page").isNotNull()).select(
        "doc_id", "page", "idx", "type", "table_id", F.coalesce("text", F.lit("")).alias("text"),
        F.sum(is_table).over(page.orderBy("idx")).alias("gap"),
        F.sum(is_table).over(page).alias("n_tables"),
    )
    items = F.array_sort(F.collect_list(F.struct("idx", "text")))
    gaps = placed.where(F.col("type") != "table").groupBy("doc_id", "page", "gap").agg(
        items.alias("items"), F.first("n_tables").alias("n_tables")
    )
    n = F.size("items")
    taken = F.when(F.col("gap") < F.col("n_tables"), n - 1).otherwise(F.least(n, F.lit(reach)))
    sides = gaps.select(
        "doc_id", "page", "gap", _join_texts(F.col("items")).alias("before"),
        _join_texts(F.slice("items", F.lit(1), taken)).alias("after"),
    )
    tables = placed.where(F.col("type") == "table").select("doc_id", "page", "table_id", "gap")
    before = sides.select("doc_id", "page", (F.col("gap") + 1).alias("gap"), "before")
    after = sides.select("doc_id", "page", "gap", "after")
    found = (
        tables.join(before, ["doc_id", "page", "gap"], "left")
        .join(after, ["doc_id", "page", "gap"], "left")
        .drop("gap")
    )
    pageless = elements.where(
        (F.col("type") == "table") & F.col("page").isNull()
    ).select("doc_id", "page", "table_id")
    return found.unionByName(pageless, allowMissingColumns=True).select(
        "doc_id", "table_id", "page", F.coalesce("before", F.lit("")).alias("before"),
        F.coalesce("after", F.lit("")).alias("after"),
    )


def picture_context(elements: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, idx, before, after): the nearest texts on the page that are not pictures.

    Texts are numbered along the page, so a picture asks for at most ``2 * reach``
    numbers by equality.
    """
    page = Window.partitionBy("doc_id", "_page").orderBy("idx")
    eligible = (F.col("type") != "picture") & (F.length(strip(F.col("text"))) > 0)
    placed = elements.withColumn("_page", F.coalesce("page", F.lit(-1))).withColumn(
        "_nth", F.sum(F.coalesce(eligible, F.lit(False)).cast("int")).over(page)
    )
    texts = placed.where(eligible).select(
        "doc_id", "_page", "_nth", normalize_text(F.col("text")).alias("_text")
    )
    offsets = F.sequence(F.lit(1 - reach), F.lit(reach))
    asked = (
        placed.where(F.col("type") == "picture")
        .select("doc_id", "idx", "_page", F.col("_nth").alias("_at"), F.explode(offsets).alias("_o"))
        .withColumn("_nth", F.col("_at") + F.col("_o"))
    )
    found = asked.join(texts, ["doc_id", "_page", "_nth"], "left")

    def side(condition: Column) -> Column:
        rows = F.collect_list(
            F.when(condition & F.col("_text").isNotNull(), F.struct("_o", "_text"))
        )
        return F.transform(F.array_sort(rows), lambda r: r["_text"])

    return found.groupBy("doc_id", "idx").agg(
        F.array_join(F.filter(side(F.col("_o") <= 0), lambda t: F.length(t) > 0), "\n")
        .alias("before"),
        F.array_join(side(F.col("_o") > 0), "\n").alias("after"),
    )


def adjacent_prose(
    chunks: DataFrame, key: str = "doc_id", pos: str = "chunk_id", limit: int = ADJACENT_CHARS
) -> DataFrame:
    """Add ``previous`` and ``following``: the nearest prose chunks, other kinds skipped.

    Taken from the chunks as they came in, so the result does not depend on the
    order in which they are rewritten.
    """
    prose = F.col("type") == "content"
    text = F.coalesce("text", F.lit(""))
    tail = F.when(prose, F.right(text, F.lit(limit)))
    head = F.when(prose, F.left(text, F.lit(limit)))
    out = neighbour(chunks, [key], pos, tail, "previous")
    out = neighbour(out, [key], pos, head, "following", following=True)
    return out.withColumns({
        c: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit("(none)"))
        for c in ("previous", "following")
    })
