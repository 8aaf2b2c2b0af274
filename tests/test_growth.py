"""Tables in many part files, and Python steps over large batches."""

import pandas as pd
import pytest

from folioquery.operators import slices
from folioquery.plans import QUERIES
from folioquery.sources import html


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_a_folder_or_as_a_file(spark, tmp_path, files):
    rows = [(i, f"http://x/{i}", f"<p>Page number {i} has words enough to pass.</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(files)
    parts = tmp_path / "parts"
    pages.write.parquet(str(parts))
    if files == 1:
        next(parts.glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    else:
        parts.rename(tmp_path / "pages.parquet")
    spark.createDataFrame([(4, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["stream_ingest_pages"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.status) for r in got) == [(i, "skipped" if i == 4 else "accepted") for i in range(9)]


def test_python_steps_hold_a_slice_of_their_batch_at_a_time():
    sizes = [400_000, 700_000, 5_000_000, 10, 10]
    assert [(s.start, s.stop) for s in slices.bounds(sizes)] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert [s.stop - s.start for s in slices.bounds([0] * 2_500)] == [1_000, 1_000, 500]
    assert list(slices.bounds([])) == [slice(0, 0)]
    frame = pd.DataFrame({"id": range(5), "text": ["x" * n for n in sizes], "more": [None, "y", ["z"], b"b", ""]})
    assert [list(f["id"]) for f in slices.frame_slices(iter([frame, frame[:0]]), ["text", "more"])] == [[0], [1], [2], [3, 4], []]


def test_pages_of_one_batch_are_parsed_in_slices(spark, monkeypatch):
    """Each call of the Python step gives several small batches, none of which holds all entries."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 2)
    pages = spark.createDataFrame([(i, f"<p>page {i}</p>" if i != 3 else None) for i in range(5)], "id int, html string").coalesce(1)
    got = pages.select("id", html.html_entries(pages.html).alias("e")).collect()
    assert [(r.id, [x.text for x in r.e]) for r in got] == [(i, [f"page {i}"] if i != 3 else []) for i in range(5)]
