import random

import pytest
import regex
from pyspark.sql import functions as F

from folioquery.functions.text import TOKEN_PATTERN
from folioquery.operators import chunking as C
from folioquery.operators.elements import ENTRY, align_pictures, convert_entries

ELEMENT = (
    "doc_id string, idx long, page int, type string, text string, level int, table_id string, "
    "vl struct<type:string,data:string,text:string,img:string>"
)
TABLE = "doc_id string, table_id string, html string, caption string, blocks array<string>"


def ntok(text):
    return len(regex.findall(TOKEN_PATTERN, text))


def elements_of(spark, docs):
    rows = []
    for doc, items in docs.items():
        for i, e in enumerate(items):
            rows.append((doc, i, e.get("page", 1), e["type"], e.get("text", ""), e.get("level", 0),
                         e.get("table_id"), e.get("vl")))
    return spark.createDataFrame(rows, ELEMENT)


def naive_chunks(items, size, overlap):
    """Straightforward one-document statement of the chunk rules (prose only)."""
    stack, sections = [], []
    for i, e in enumerate(items):
        if e["type"] == "heading":
            level = e["level"] or 1
            stack = [h for h in stack if h[0] < level] + [(level, e["text"])]
        elif e["text"]:
            crumb = " > ".join(t for _, t in stack)
            if not sections or sections[-1][0] != crumb:
                sections.append((crumb, []))
            sections[-1][1].append((i, e))
    out = []
    for crumb, atoms in sections:
        budget = max(size - ntok(crumb), 64)
        prefix = crumb + "\n\n" if crumb else ""
        group = []

        def close():
            if group:
                out.append((group[0][1].get("page", 1), prefix + "\n\n".join(e["text"] for _, e in group),
                            group[0][0], group[-1][0] + 1))
                group.clear()

        for i, e in atoms:
            if ntok(e["text"]) > budget:
                close()
                out.extend((e.get("page", 1), prefix + f, i, i + 1) for f in C.split_paragraph(e["text"], budget, overlap))
                continue
            if group and sum(ntok(x["text"]) for _, x in group) + ntok(e["text"]) > budget:
                close()
            group.append((i, e))
        close()
    return out


@pytest.mark.parametrize("text,budget,overlap,want", [
    ("a b\nc d\ne", 4, 0, ["a b\nc d", "e"]),
    ("a b c\nd\n\ne", 3, 0, ["a b c", "d\n\ne"]),
    ("p q r s t", 4, 0, ["p q", "r s", "t"]),
    ("p q r s t", 4, 2, ["p q", "q r", "r s", "s t"]),
    ("x\np q r\ny", 2, 0, ["x", "p", "q", "r", "y"]),
    ("", 5, 0, [""]),
    ("toolong1234567890 z", 2, 0, ["toolong1234567890", "z"]),
])
def test_long_paragraphs_worked_by_hand(text, budget, overlap, want):
    """A word in a window costs its tokens and one; a line costs its tokens."""
    assert C.split_paragraph(text, budget, overlap) == want


def random_document(rng, n, headings, long_share=0.03):
    items = []
    for i in range(n):
        page = i // 7 + 1
        if rng.random() < headings:
            items.append({"type": "heading", "level": rng.choice([0, 1, 2, 2, 3]), "page": page,
                          "text": rng.choice(["", "Alpha", "Beta 1", "Gamma delta"])})
        elif rng.random() < long_share:
            lines = [" ".join(["word"] * rng.choice([3, 60, 150])) for _ in range(rng.randint(1, 3))]
            items.append({"type": "paragraph", "text": "\n".join(lines), "page": page})
        else:
            items.append({"type": rng.choice(["paragraph", "equation"]), "page": page,
                          "text": " ".join(["tok"] * rng.randint(1, 40))})
    return items


@pytest.mark.parametrize("seg_len", [5, 16, 1024])
def test_chunks_equal_the_plain_rules(spark, seg_len):
    rng = random.Random(seg_len)
    docs = {f"d{k}": random_document(rng, rng.randint(1, 90), h)
            for k, h in enumerate([0, 0, 0.05, 0.2, 0.5, 0.1])}
    # No heading and equal sizes: the open chunk never settles on its own.
    docs["even"] = [{"type": "paragraph", "text": " ".join(["x"] * 35), "page": 1} for _ in range(70)]
    tables = spark.createDataFrame([], TABLE)
    chunks, _ = C.split_documents(elements_of(spark, docs), tables, 70, 20, seg_len=seg_len)
    got = {}
    for r in chunks.orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.text, r.els_start, r.els_end))
        assert r.chunk_id == len(got[r.doc_id]) - 1
        assert r.length_tokens == ntok(r.text)
    for doc, items in docs.items():
        assert got.get(doc, []) == naive_chunks(items, 70, 20), doc


def test_packing_golden(spark):
    sizes = [100, 150, 80, 400, 20, 290]
    docs = {"d": [{"type": "paragraph", "text": " ".join(["w"] * n)} for n in sizes]}
    chunks, _ = C.split_documents(elements_of(spark, docs), spark.createDataFrame([], TABLE))
    spans = [(r.els_start, r.els_end) for r in chunks.orderBy("chunk_id").collect()]
    assert spans[:2] == [(0, 2), (2, 3)] and spans[-2:] == [(4, 5), (5, 6)]
    assert set(spans[2:-2]) == {(3, 4)} and len(spans) > 5


def test_breadcrumb_golden(spark):
    docs = {"d": [{"type": "heading", "level": 1, "text": "A"}, {"type": "heading", "level": 2, "text": "B"},
                  {"type": "heading", "level": 2, "text": "C"}, {"type": "paragraph", "text": "p"}]}
    for seg_len in (1, 2, 1024):
        row = C.heading_breadcrumbs(elements_of(spark, docs), seg_len=seg_len).first()
        assert (row.idx, row.crumb) == (3, "A > C")


def table_document(spark, blocks, caption="Sales"):
    docs = {"d": [{"type": "paragraph", "text": "Intro"},
                  {"type": "table", "text": caption, "table_id": "t0"},
                  {"type": "picture", "text": "Fig", "vl": ("chart", "HAS_DATA", "values", "i.jpg")},
                  {"type": "picture", "text": "Logo", "vl": ("logo", "NO_DATA", "", "j.jpg")}]}
    tables = spark.createDataFrame([("d", "t0", "<table>raw</table>", caption, blocks)], TABLE)
    return elements_of(spark, docs), tables


def test_table_and_picture_units(spark):
    elements, tables = table_document(spark, ["block one", "block two"])
    chunks, pages = C.split_documents(elements, tables)
    rows = {r.type: r for r in chunks.collect()}
    assert rows["serialized_table"].text == "Table: Sales\nblock one\nblock two"
    assert rows["serialized_image"].text == "values" and rows["serialized_image"].img == "i.jpg"
    assert pages.first().text == "Intro\n\nTable: Sales\nblock one\nblock two\n\nFig\nvalues\n\nLogo"
    chunks, pages = C.split_documents(elements, tables, table_source="html")
    rows = {r.type: r for r in chunks.collect()}
    assert rows["serialized_table"].text == "Table: Sales\n<table>raw</table>"
    assert "block one" not in pages.first().text
    with pytest.raises(ValueError):
        C.split_documents(elements, tables, table_source="other")


def test_empty_table_makes_no_chunk(spark):
    elements, tables = table_document(spark, [], caption="")
    chunks, _ = C.split_documents(elements, tables)
    assert "serialized_table" not in {r.type for r in chunks.collect()}


def test_percentile_positions(spark):
    for n in (1, 2, 20, 21):
        rows = [("d", "content", t) for t in range(n)]
        df = spark.createDataFrame(rows, "doc_id string, type string, length_tokens int")
        r = C.chunk_stats(df).first()
        assert (r.p50, r.p95, r.max_tokens, r.n_chunks) == (n // 2, int(n * 0.95), n - 1, n)


def test_missing_chunk_ids(spark):
    df = spark.createDataFrame(
        [("ok", 0, "a"), ("ok", 1, "b"), ("gap", 0, "a"), ("gap", 2, "b"), ("blank", 0, " ")],
        "doc_id string, chunk_id long, text string")
    assert {r.doc_id for r in C.missing_chunk_ids(df).collect()} == {"gap", "blank"}


def test_convert_entries(spark):
    entries = [
        {"type": "text", "page_idx": 0, "text": " Title ", "text_level": 1},
        {"type": "discarded", "page_idx": 0, "text": "header"},
        {"type": "text", "page_idx": 0, "text": "  "},
        {"type": "table", "page_idx": 1, "table_caption": ["A", "B "], "table_body": "<t/>"},
        {"type": "image", "page_idx": None, "image_caption": None, "img_path": "x.jpg"},
        {"type": "table", "page_idx": 2},
        {"type": "equation", "page_idx": 2, "text": "e=mc2"},
        {"type": None, "page_idx": 2, "text": "odd"},
    ]
    names = ["type", "page_idx", "text", "text_level", "table_caption", "table_body", "image_caption", "img_path"]
    rows = [("d", [tuple(e.get(n) for n in names) for e in entries])]
    df = spark.createDataFrame(rows, f"doc_id string, entries array<{ENTRY}>")
    out = convert_entries(df).orderBy("idx").collect()
    assert [(r.type, r.page, r.text, r.level, r.table_id) for r in out] == [
        ("heading", 1, "Title", 1, None), ("table", 2, "A B", 0, "t0"), ("picture", None, "", 0, None),
        ("table", 3, "", 0, "t1"), ("equation", 3, "e=mc2", 0, None), ("unknown", 3, "odd", 0, None)]


def test_pictures_with_other_counts_are_refused(spark):
    pics = spark.createDataFrame([("a", 0, 1, "picture"), ("a", 3, 1, "picture"), ("b", 1, 1, "picture")],
                                 "doc_id string, idx long, page int, type string")
    imgs = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 0, "z"), ("b", 1, "w")],
                                 "doc_id string, seq long, img_path string")
    out = {(r.doc_id, r.idx): (r.img, r.aligned) for r in align_pictures(pics, imgs).collect()}
    assert out == {("a", 0): ("x", True), ("a", 3): ("y", True), ("b", 1): (None, False)}


def test_report_of_many_elements(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("idx"), (F.col("id") / 50).cast("int").alias("page"),
        F.when(F.col("id") % 1000 == 0, "heading").otherwise("paragraph").alias("type"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("level"),
        F.lit(None).cast("string").alias("table_id"),
        F.lit(None).cast("struct<type:string,data:string,text:string,img:string>").alias("vl"),
    )
    chunks, _ = C.split_documents(rows, spark.createDataFrame([], TABLE))
    got = chunks.agg(F.sum(F.col("els_end") - F.col("els_start")).alias("els"), F.max("length_tokens").alias("most")).first()
    assert got.els == n - n // 1000 and got.most <= 300
