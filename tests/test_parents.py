import pytest
from pyspark.sql import functions as F

from folioquery.operators import parents
from folioquery.operators.context import adjacent_prose, picture_context, table_context

CAND = "q int, doc_id string, els_start long, els_end long, page int, rank int"


def test_spans_merge_when_they_touch(spark):
    df = spark.createDataFrame([(1, "d", 3, 5, 1, 1), (1, "d", 0, 3, 1, 2), (1, "d", 7, 9, 1, 3)], CAND)
    out = parents.merged_spans(df, ["q"]).orderBy("span_start").collect()
    assert [(r.span_start, r.span_end) for r in out] == [(0, 5), (7, 9)]
    assert parents.halving(15) == [15, 7, 3, 1, 0]


def test_window_shrinks_until_the_text_fits(spark):
    parts = spark.createDataFrame([("d", i, "x" * 10) for i in range(100)], "doc_id string, idx long, part string")
    cand = spark.createDataFrame([(1, "d", 50, 51, 1, 1), (1, "d", 60, 61, 1, 2)], CAND)
    for cap, want in ((10**6, [(35, 76)]), (200, [(47, 54), (57, 64)]), (5, [(50, 51), (60, 61)])):
        out = parents.window_texts(cand, parts, ["q"], max_chars=cap).orderBy("span_start").collect()
        assert [(r.span_start, r.span_end) for r in out] == want
    assert out[0].text == "x" * 10


def test_parent_pages_first_wins(spark):
    cand = spark.createDataFrame([(1, "d", 0, 1, 7, 1), (1, "d", 0, 1, 3, 2), (1, "d", 0, 1, 7, 3)], CAND)
    pages = spark.createDataFrame([("d", 3, "three"), ("d", 7, "seven")], "doc_id string, page int, text string")
    out = parents.parent_context(cand, ["q"], "pages", pages=pages).orderBy("page_rank").collect()
    assert [(r.page, r.text) for r in out] == [(7, "seven"), (3, "three")]
    with pytest.raises(ValueError):
        parents.parent_context(cand, ["q"], "other")


def test_prefix_limits(spark):
    rows = [(1, 1, 50000), (1, 2, 20000), (1, 3, 100), (2, 1, 70000), (2, 2, 5)]
    df = spark.createDataFrame(rows, "q int, n int, size int")
    kept = parents.keep_prefix(df, ["q"], "n", F.col("size"))
    assert {(r.q, r.n) for r in kept.collect()} == {(1, 1)}
    kept = parents.keep_prefix(df, ["q"], "n", F.col("size"), 16000, keep_first=True)
    assert {(r.q, r.n) for r in kept.collect()} == {(1, 1), (2, 1)}


def test_prefix_over_many_segments(spark):
    df = spark.createDataFrame([(1, i, 1) for i in range(10000)], "q int, n int, size int")
    assert parents.keep_prefix(df, ["q"], "n", F.col("size"), 9000).count() == 9000


def test_valid_pages(spark):
    rows = [([9, 3, 3], [3, 5, 7]), ([], [3, 5, 7]), ([7, 5, 3], [3, 5, 7]), ([1], []),
            (list(range(10)), list(range(10)))]
    df = spark.createDataFrame(rows, "cited array<int>, provided array<int>")
    got = [r[0] for r in df.select(parents.valid_pages(F.col("cited"), F.col("provided"))).collect()]
    assert got == [[3, 5], [3, 5], [7, 5, 3], [], [0, 1, 2, 3, 4, 5, 6, 7]]
    refs = df.select(parents.references(F.col("cited"), F.lit(None).cast("string")).alias("r")).first().r
    assert (refs[0].pdf_sha1, refs[0].page_index) == ("", 9)


ELEMENT = "doc_id string, idx long, page int, type string, text string, table_id string"


def test_table_context(spark):
    page = ["a", "T0", "b", "c", "d", "T1", "e", "f", "g", "h"]
    rows = [("d", i, 1, "table" if t[0] == "T" else "paragraph", t if t[0] != "T" else "",
             f"t{t[1]}" if t[0] == "T" else None) for i, t in enumerate(page)]
    rows.append(("d", 99, None, "table", "", "t9"))
    out = {r.table_id: (r.before, r.after)
           for r in table_context(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert out == {"t0": ("a", "b\nc"), "t1": ("b\nc\nd", "e\nf\ng"), "t9": ("", "")}


def test_picture_context(spark):
    texts = ["a", "", "b", "c", "d", None, "PIC", "e", "f", "PIC", "g", "h"]
    rows = [("d", i, 1, "picture" if t == "PIC" else "paragraph", t, None) for i, t in enumerate(texts)]
    rows.append(("d", 50, 2, "paragraph", "other page", None))
    out = {r.idx: (r.before, r.after)
           for r in picture_context(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert out == {6: ("b\nc\nd", "e\nf\ng"), 9: ("d\ne\nf", "g\nh")}


def test_adjacent_prose_over_segments(spark):
    rows = [("d", i, "content" if i % 5000 == 0 else "serialized_table", f"c{i}") for i in range(10001)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id long, type string, text string")
    out = {r.chunk_id: (r.previous, r.following)
           for r in adjacent_prose(df).where("chunk_id in (0, 1, 5000, 9999)").collect()}
    assert out == {0: ("(none)", "c5000"), 1: ("c0", "c5000"), 5000: ("c0", "c10000"),
                   9999: ("c5000", "c10000")}
