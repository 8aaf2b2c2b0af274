import pytest
from pyspark.sql import functions as F

from folioquery.functions import answers as A
from folioquery.operators import evaluation as E

CASES = [
    ("number", "(2,124,837)", "-2124837", True), ("number", "100", "101", True),
    ("number", "100", "102", False), ("number", "N/A", "n/a", True), ("number", "N/A", "5", False),
    ("number", "58.3%", "58.3", True), ("number", "1_000", "1000", True), ("number", "1.5f", "1.5", False),
    ("number", "nan", "nan", False), ("number", "0", "0", True), ("number", "inf", "inf", True),
    ("boolean", "Yes", "true", True), ("boolean", "0", "False", True), ("boolean", "maybe", "Maybe!", False),
    ("boolean", "maybe", "MAYBE", True), ("name", "N/A", "John Adams", True), ("name", "", "x", False),
    ("name", "Holley Inc.", "holley", True), ("name", "Société", "société x", True),
    ("other", "A  b", "a b", True), ("names", "A", "a", True), ("names", "A", "b", False),
]


def test_match_rules(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, kind string, p string, g string")
    out = df.select("i", A.score_answer(
        F.col("p"), F.array("p"), A.golds_of(F.array("g")), F.col("kind")).alias("ok")).collect()
    for r in out:
        assert r.ok == CASES[r.i][3], CASES[r.i]


def test_names_are_sets_against_each_gold(spark):
    df = spark.createDataFrame([("['A', 'B']",), ("[['B', 'a']]",)], "g string")
    ok = df.select(A.score_answer(F.lit("x"), F.array(F.lit("A"), F.lit("B")), A.parse_golds(F.col("g")),
                                  F.lit("names"))).collect()
    assert [r[0] for r in ok] == [False, True]


@pytest.mark.parametrize("text,want", [
    ("['a', 'b']", ["a", "b"]), ("[true, 'x']", ["True", "x"]), ("[‘a’, ‘b’]", ["a", "b"]),
    ("['it's', \"b\"]", ["it", ", \"b\"]"][:1]), ("plain", ["plain"]), ("[5.0]", ["5.0"]),
])
def test_gold_spellings(spark, text, want):
    df = spark.createDataFrame([(text,)], "g string")
    got = [g.text for g in df.select(A.parse_golds(F.col("g")).alias("g")).first().g]
    assert got[:len(want)] == want


def test_na_and_kinds(spark):
    df = spark.createDataFrame([("N/A",), ("N/A.",), (" none ",), ("",)], "v string")
    assert [r[0] for r in df.select(A.is_na(F.col("v"))).collect()] == [True, False, True, True]
    qs = ["Did it?", "How many people?", "Who were the directors?", "Who is the CEO?", "Amount due"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert [r[0] for r in df.select(A.guess_kind(F.col("q"))).collect()] == [
        "boolean", "number", "names", "name", "number"]


def test_slices_and_missing_predictions(spark):
    preds = spark.createDataFrame([("q1", "5", ["5"]), ("q2", None, ["None"])],
                                  "question string, final_answer string, items array<string>")
    gold = spark.createDataFrame([("q1", "number", ["5"]), ("q2", "number", ["N/A"]), ("q3", "name", ["x"])],
                                 "question string, kind string, g array<string>")
    scored = E.score_run(preds, gold.select("question", "kind", A.golds_of(F.col("g")).alias("golds")))
    got = {r.slice: (r.n_ok, r.n) for r in E.accuracy_slices(scored).collect()}
    assert got == {"overall": (2, 2), "kind:number": (2, 2), "na": (1, 1), "answerable": (1, 1)}


def test_recall_counts_distinct_pages(spark):
    cands = spark.createDataFrame([(1, "d", 4, 1), (1, "d", 4, 2), (1, "d", 9, 3)],
                                  "question_id int, doc_id string, page int, rank int")
    pools = spark.createDataFrame([(1, 0, "d", 9), (1, 0, "d", 9), (1, 1, "e", 1), (1, 1, "d", 4), (1, 2, "d", 5)],
                                  "question_id int, pool_no int, doc_id string, page int")
    usable = E.usable_pools(pools, cands)
    assert {r.pool_no for r in usable.collect()} == {0, 2}
    got = {r.k: r.recall for r in E.recall_at(cands, usable, (1, 2)).collect()}
    assert got == {1: 0.0, 2: 0.5}


def test_reference_split_at_last_colon(spark):
    doc, page = E.split_reference(F.col("r"))
    row = spark.createDataFrame([("a:b:12",)], "r string").select(doc, page).first()
    assert tuple(row) == ("a:b", 12)


def test_latest_baseline_counters_means(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "question string, final_answer string, n int")
    assert E.latest_answers(run, "n").first().final_answer == "b"
    sub = spark.createDataFrame([([("q", "v", "name")],)],
                                "answers array<struct<question_text:string,value:string,kind:string>>")
    assert tuple(E.baseline_answers(sub).first()) == ("q", "v", "name")
    rated = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (1.0,)], "faithfulness double")
    assert E.metric_means(rated, ["faithfulness"]).first().faithfulness == 0.75


def test_judge_rows(spark):
    answers = spark.createDataFrame([("q1", "5"), ("q2", "N/A"), ("q3", "x")], "question string, final_answer string")
    gold = spark.createDataFrame([("q1", ["6"]), ("q2", ["1"]), ("q3", ["y"])], "question string, g array<string>")
    gold = gold.select("question", A.golds_of(F.col("g")).alias("golds"))
    ctx = spark.createDataFrame([("q1", 1, "long text"), ("q1", 2, "b"), ("q2", 1, "c")],
                                "question string, ordinal int, text string")
    rows = E.judge_rows(answers, gold, ctx, cap=5).collect()
    assert [(r.user_input, r.retrieved_contexts, r.response, r.reference) for r in rows] == [
        ("q1", ["long text"], "5", "6")]
