"""Failed files are all tried until their tries are used up, however many rounds that takes."""

import sys

from pyspark import cloudpickle

from folioquery.streaming import ingest as I

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the reader runs in tasks


def given(spark, names):
    rows = [(f"/in/{n}.pdf", n, "s", n.encode()) for n in names]
    return spark.createDataFrame(rows, "source string, doc_id string, sha1 string, content binary")


def read(content):
    if content.startswith(b"bad"):
        raise ValueError("bad")
    return [{"type": "text", "page_idx": 0, "text": "t", "text_level": None, "table_caption": None, "table_body": None,
             "image_caption": None, "img_path": None}]


def tried(spark, tmp_path, names):
    """An output folder whose ledger has one failed attempt of every file."""
    out = str(tmp_path / "out")
    stamp = [(n, f"/in/{n}.pdf", "failed", "PDF_PARSE_FAILED", f"2026-01-01 00:00:0{i % 7}") for i, n in enumerate(names)]
    ledger = spark.createDataFrame(stamp, "doc_id string, source string, status string, error_code string, at string")
    ledger.withColumn("at", ledger["at"].cast("timestamp")).write.parquet(f"{out}/ledger/batch=0")
    return out


def test_rounds_without_a_report_leave_no_file_behind(spark, tmp_path):
    names = [f"bad{i}" for i in range(5)]
    out = tried(spark, tmp_path, names)
    assert I.retry_failed(given(spark, names), out, read, max_tries=2, per_round=1, stall_limit=3) == 5
    assert {r.doc_id: (r.tries, r.status) for r in I.attempts(spark, out).collect()} == {n: (2, "failed") for n in names}


def test_a_later_round_brings_the_report(spark, tmp_path):
    names = [*(f"bad{i}" for i in range(3)), "good"]
    out = tried(spark, tmp_path, names)
    assert I.retry_failed(given(spark, names), out, read, max_tries=4, per_round=2, stall_limit=1) == 4
    # the second pass brings no report and is the last one
    assert {r.doc_id: (r.tries, r.status) for r in I.attempts(spark, out).collect()} == {
        "bad0": (3, "failed"), "bad1": (3, "failed"), "bad2": (3, "failed"), "good": (2, "accepted")}


def test_turns_are_full_and_in_order(spark, tmp_path):
    names = [f"f{i:02d}" for i in range(23)]
    out = tried(spark, tmp_path, names)
    turns = {r.doc_id: r._turn for r in I._turns(I.attempts(spark, out).repartition(5), 4).collect()}
    order = sorted(names, key=lambda n: (int(n[1:]) % 7, n))
    assert turns == {n: i // 4 for i, n in enumerate(order)}
