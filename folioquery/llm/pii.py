"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

All columns are built-in expressions. A pattern's matches come from two functions that
walk a text alike: ``regexp_extract_all`` gives the matches and ``split`` the gaps between
them, so running lengths give positions in code points.

Base kinds: email, ip, card (Luhn), phone. Added kinds: iban (mod 97), national_id and
local_phone (only with a fitting word before them). Added spans that overlap a base span
are dropped. Defined results: a null or empty text has no spans; repeated rows are judged
one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import packed, unpacked

#: The patterns take possessive steps and anchors that cannot change a match, so long runs
#: of pattern characters cost linear time.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only runs of 14 digits and more are matched, each from its first digit: a text full of short numbers has no matches.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country code. A match ends there, so a word or number after a blank is not part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_CODES = "|".join(" ".join(IBAN_LENGTHS.values()).split())
#: Codes without a known length match as far as they can, but not into a number with a known one.
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:%s|(?!%s)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]|\x20(?!(?:%s)[0-9]{2})[A-Z0-9]){11,30})(?![A-Za-z0-9])" % (
    "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()), _CODES, _CODES
)
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

#: kind, pattern, text needed for a match to exist, score without context, context words.
BASE = (
    ("email", EMAIL, "@", 0.9, "mail|contact|write"),
    ("ip", IP, "[0-9]", 0.7, "ip|host|server|address"),
    ("card", CARD, "[0-9]", 0.8, "card|visa|credit|payment"),
    ("phone", PHONE, r"\+[0-9]", 0.8, "tel|phone|call|fax|mobile"),
)
ADDED = (
    ("iban", IBAN, "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank"),
    ("national_id", NATIONAL_ID, "[0-9]-[0-9]", 0.3, "ssn|social security|national id|tax id"),
    ("local_phone", LOCAL_PHONE, "[0-9]", 0.4, "tel|phone|call|fax|mobile"),
)
ORDER = [k[0] for k in (*BASE, *ADDED)]
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
MIN_ADDED_SCORE = 0.6
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value, before)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        one = F.struct(
            begin.alias("start"), end.alias("end"), x["value"].alias("value"),
            F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.conv(c, 36, 10).cast("int")
        return F.when(code > 9, (acc * 100 + code) % 97).otherwise((acc * 10 + code) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, value: Column) -> Column:
    """The checksum or range test of a kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return _mod97(value) == 1
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, needs: str, score: float, context: str) -> Column:
    def span(m: Column) -> Column:
        near = F.lower(m["before"]).rlike(rf"(?<![a-z])(?:{context})")
        return F.struct(
            m["start"].alias("start"), F.lit(ORDER.index(kind)).alias("kind_no"), m["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.least(F.lit(1.0), F.lit(score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        )

    found = F.transform(F.filter(_matches(text, pattern), lambda m: _valid(kind, m["value"])), span)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: array of (start, kind_no, end, kind, score)."""
    return F.sort_array(F.concat(*[_spans(text, *k) for k in BASE]))


def added_spans(text: Column, base: Column) -> Column:
    """Spans of the further kinds that score enough and overlap no base span."""
    found = F.concat(*[_spans(text, *k) for k in ADDED])
    return F.filter(
        found,
        lambda s: (s["score"] >= MIN_ADDED_SCORE)
        & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """The input rows with base (array of spans) and spans (base and added, by start)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows without a digit and an at sign cannot hold any kind
    some = text.rlike("[0-9@]")
    none = F.array().cast(SPAN)
    found = docs.withColumn("pii_base", F.when(some, base_spans(text)).otherwise(none))
    return found.withColumn(
        "pii_spans",
        F.when(some, F.sort_array(F.concat("pii_base", added_spans(text, F.col("pii_base"))))).otherwise(none),
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    found = find_spans(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k[0]) for k in BASE],
        F.sha2(_listed(F.col("pii_base")), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text."""
    found = find_spans(packed(docs, "text"))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the one before it only extends the replaced part
        kept = F.when(
            s["start"] >= acc["at"],
            F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept).alias("out"))

    clean = F.aggregate(
        "pii_spans", start, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    some = F.size("pii_spans") > 0
    clean_docs = found.select("doc", F.when(some, clean).otherwise(text).alias("clean"), some.alias("some"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        size = F.length("clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("some"), size).otherwise(F.col("doc").getField("n_chars"))
    return unpacked(clean_docs, docs.columns, **changed)
