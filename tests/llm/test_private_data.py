"""Personal data against the plain definition of the kinds."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import pii
from folioquery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    """Base spans by their definition, as text."""
    spans = []
    for no, kind, pattern in (
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        (2, "card", r"[0-9]([\x20-]?[0-9])+"),
        (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def digest(text):
    return hashlib.sha256(base(text).encode()).hexdigest()


HARD = [
    None, "", " ", "a@b.c", "a@b.com_x@y.zz", "a@b@c.d", "@x.y a..b@c.d.e.", "x@-.-", "\U0001f600 a@b.c \U0001f600 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.01.1.1", "1.2.3", "9999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "1 2 3", "0" * 14, "0" * 19, "0" * 20, "1" * 5000,
    "+1 (017) 555-7713", "+1", "+1 2", "++12345678901", "+1234567890+1234567890", "+1 234 567 890 123 456 7", "+4 (1) . 2345678 9 .",
    "mail x@y.zz now", "a" * 3000 + " " + "a." * 2000 + "@", ("a@b.cc " * 300), "\x1d1.1.1.1\u2028+12345678901",
    "12 34 " * 4000, "1--" + "4111 1111-1111 1111" + "  5", "9 4111111111111111", "1-2 3-" + "4111111111111111", "7" * 13, "x5 " * 9000,
    "4111  1111 1111 1111", "04 11- 11", "a1234567 8901234-5", "-4111111111111111-", "5 4-111111111111111",
    "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn: 123-45-6789", "123-45-6789", "call 212-555-0187", "212-555-0187",
]


def test_base_spans_equal_their_definition(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, spans string")
    for r in pii.report(df).collect():
        assert r.base_sha256 == digest(HARD[r.doc_id]), HARD[r.doc_id]
        found = base(HARD[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(found.count(k + ":") for k in ("email", "ip", "card", "phone"))
        assert set(found.split(",")) - {""} <= set(r.spans.split(","))


def test_random_texts(spark):
    made = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(st.lists(st.sampled_from(["a", "b-c", "@", ".", "1", "23", "255", "4111111111111111", " ", "+", "(", ")", "-", "_", "\n", "é"]), max_size=25))
    def collect(parts):
        made.append("".join(parts))

    collect()
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.report(df).collect():
        assert r.base_sha256 == digest(made[r.doc_id]), made[r.doc_id]


def test_query_equals_the_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_pii"](spark, SF).collect()
    assert len(got) == len(texts) and all(r.base_sha256 == digest(texts[r.doc_id]) for r in got)


@pytest.mark.parametrize("text,spans", [
    ("GB82 WEST 1234 5698 7654 32", "iban:0:27"), ("GB82 WEST 1234 5698 7654 33", ""), ("ssn: 123-45-6789", "national_id:5:16"),
    ("123-45-6789", ""), ("call 212-555-0187", "local_phone:5:17"), ("212-555-0187", ""),
])
def test_added_kinds_need_a_checksum_or_a_word(spark, text, spans):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.report(df).first().spans == spans


def test_redaction(spark):
    rows = [(1, "mail a@b.cc or 1.2.3.4!", 9, "p"), (2, None, None, "q"), (3, "clean", 5, None), (4, "\u00e9 +1 (017) 555-7713", 3, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii_spans string")
    got = {r.doc_id: tuple(r) for r in pii.redact(docs).collect()}
    assert got == {1: (1, "mail [email] or [ip]!", 21, "p"), 2: rows[1], 3: rows[2], 4: (4, "\u00e9 [phone]", 9, "r")}
    assert pii.redact(docs.limit(0)).count() == 0 and pii.redact(docs).columns == docs.columns


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op2_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("text,spans", [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban:5:32"), ("GB82WEST12345698765432 I", "iban:0:22"),
    ("DE89 3704 0044 0532 0130 00 2024", "iban:0:27"),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 X", "iban:0:27,iban:28:55"),
    ("NO9386011117947 BE68539007547034", "iban:0:15,iban:16:32"), ("GB82WEST12345698765432I", ""), ("AB12 DE89370400440532013000", "iban:5:27"),
])
def test_an_account_number_ends_where_its_country_says(spark, text, spans):
    found = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert ",".join(x for x in found.split(",") if x.startswith("iban")) == spans
