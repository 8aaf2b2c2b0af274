import random
import unicodedata

import pytest

from folioquery.functions.quality import analyze_page_texts, gate_page_rows


def analyze(spark, pages, threshold=0.8):
    df = spark.createDataFrame([(1, pages)], "id int, pages array<string>")
    return analyze_page_texts(df, "pages", threshold).first().quality


#: Letters, digits, signs, marks, blanks, controls, private use and the replacement mark.
ALPHABET = "mNéß漢٣7.,-+€ \t\n\u00a0\u2003\u0301\u0007\u001d\ue123\ufffd"


def plainly(pages, threshold):
    """The measures by their definition, character by character."""
    blank = [[c for c in t if not c.isspace()] for t in pages]
    read = [[c for c in t if unicodedata.category(c)[0] in "LNPS" and c != "\ufffd"] for t in blank]
    e, r = sum(map(len, blank)), sum(map(len, read))
    code = "NO_RECOGNIZABLE_TEXT" if not r else "LOW_VALID_CHAR_RATIO" if r / e < threshold else None
    n = len(pages)
    return (code is None, r / e if e else 0.0, e, r, n, r / n, sum(map(bool, read)) / n, code)


@pytest.mark.parametrize("seed", range(3))
def test_random_pages_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        weights = [rng.random() ** 3 for _ in ALPHABET]
        pages = ["".join(rng.choices(ALPHABET, weights, k=rng.choice([0, 1, 5, 40]))) for _ in range(rng.randint(1, 6))]
        rows.append((i, pages))
    df = spark.createDataFrame(rows, "id int, pages array<string>")
    for r in analyze_page_texts(df, "pages", 0.6).collect():
        q = r.quality
        got = (q.passed, q.valid_char_ratio, q.extracted_chars, q.recognizable_chars, q.sample_pages, q.average_chars_per_page,
               q.text_page_ratio, q.error_code)
        assert got == pytest.approx(plainly(rows[r.id][1], 0.6)), rows[r.id]
        assert (q.reason is None) == q.passed


@pytest.mark.parametrize("good", range(6))
def test_a_ratio_at_the_threshold_passes(spark, good):
    q = analyze(spark, ["k" * good + "\ufffd" * (5 - good)], threshold=0.4)
    assert q.passed == (good >= 2)


def test_rows_agree_with_arrays(spark):
    pages = ["xy 7\n", "", "z\ufffd", "vv", "u", "later"]
    rows = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(pages)],
                                 "doc_id string, page int, text string")
    assert gate_page_rows(rows, sample_pages=5).first().quality == analyze(spark, pages[:5])


@pytest.mark.parametrize("sample,threshold", [(0, 0.5), (-3, 0.5), (4, -0.2), (4, 1.5)])
def test_bad_options(spark, sample, threshold):
    rows = spark.createDataFrame([("d", 1, "x")], "doc_id string, page int, text string")
    with pytest.raises(ValueError):
        gate_page_rows(rows, sample_pages=sample if sample else -1, threshold=threshold)
