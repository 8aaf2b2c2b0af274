from pyspark.sql import functions as F

from folioquery.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


def test_normalize_once_and_twice(spark):
    once = one(spark, X.normalize_text, "fi scal")
    assert once == "fi scal"
    assert one(spark, X.normalize_text, once) == "fiscal"
    assert one(spark, X.normalize_text, "a\tb") == "ab"
    assert one(spark, X.normalize_text, "fi ve years \n\n\n\nof  the fl ow  ") == "five years\n\nof the flow"
    assert one(spark, X.normalize_text, "wi​fi x") == "wifi x"
    assert one(spark, X.normalize_text, "éfi x") == "éfi x"
    assert one(spark, X.normalize_text, "fi fl ow") == "fiflow"
    assert one(spark, X.normalize_text, None) is None


def test_tokens(spark):
    assert one(spark, X.lexical_tokens, "Q3x Cash €7,001.25 fell 31%") == ["q3x", "cash", "7,001.25", "fell", "31"]
    assert one(spark, X.numeric_tokens, "In 1987 cash was €7,001.25 or 31%") == ["1987", "7,001.25", "31%"]
    assert one(spark, X.token_count, "") == 0
    assert one(spark, X.token_count, "Cash: 98765 <gross>") == 7


def test_numeric_conservation(spark):
    f = X.numeric_conservation
    assert one(spark, f, "Cash of 7,001.25 left", "Cash left") == "numeric_tokens_missing: 7,001.25"
    assert one(spark, f, "Cash of 7,001.25 left", "7,001.25 is left") is None
    assert one(spark, f, "y", "\t \n") == "empty_transformed_text"
    assert one(spark, f, "4 and 5 and 4", "6") == "numeric_tokens_missing: 4, 5"


def test_paths_and_snippets(spark):
    for name in ("plain", "two.dots", "a b", ".hidden", "x.y.z"):
        assert one(spark, X.stem, f"shelf/{name}.pdf") == name
    assert one(spark, X.basename, "in/deep/z.pdf") == "z.pdf"
    assert one(spark, X.snippet, "x\ny") == "x y"
    assert one(spark, lambda c: X.snippet(c, 2), "wxyz") == "wx…"


def test_truncate_keeps_the_head(spark):
    text = "one two,  three\nfour"
    assert one(spark, lambda c: X.token_truncate(c, 4), text) == "one two,  three"
    assert one(spark, lambda c: X.token_truncate(c, 9), text) == text
    long = "word " * 12000
    assert one(spark, lambda c: X.token_truncate(c, 8000), long) == ("word " * 8000).rstrip()
