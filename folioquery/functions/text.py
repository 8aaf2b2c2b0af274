"""Column expressions over text: normalization, tokens, numbers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# Characters that count as whitespace when text is stripped or measured.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a character class (valid in Java and in RE2).
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
CONTROL_PATTERN = r"[\x00-\x09\x0B-\x1F\x7F\x{200B}\x{FEFF}]"
LIGATURE_PATTERN = r"(?U)\b(fi|fl) (?=[a-z])"
LEXICAL_PATTERN = r"\d+(?:[.,]\d+)*|[a-z][a-z0-9]*"
NUMBER_PATTERN = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
UNRECOGNIZABLE_PATTERN = r"[^\p{L}\p{N}\p{P}\p{S}]|\x{FFFD}"
# Model-token estimate: a letter run, up to three digits, or a symbol run.
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^ \t\n\r\p{L}\p{N}]+"
# ----------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """Drop control characters, rejoin split ligatures, collapse blanks, strip.

    One application is not always a fixed point: joining happens before
    non-breaking and repeated blanks are reduced.  Stages that are documented to
    normalize twice must call this twice.
    """
    text = F.regexp_replace(text, CONTROL_PATTERN, "")
    text = F.regexp_replace(text, LIGATURE_PATTERN, "$1")
    text = F.replace(text, F.lit("\xa0"), F.lit(" "))
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def lexical_tokens(text: Column) -> Column:
    """Search terms: ASCII words and numbers that keep separators inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_PATTERN), F.lit(0))


def numeric_tokens(text: Column) -> Column:
    """Numbers in reading order, with thousands separators and a percent sign."""
    return F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Default model-token estimate; empty text has no tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0))


def token_truncate(text: Column, cap: int) -> Column:
    """Keep the text up to the end of its ``cap``-th token."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[ \t\n\r]*(?:{TOKEN_PATTERN})"), F.lit(0))
    return F.when(
        token_count(text) > cap, F.array_join(F.slice(pieces, 1, cap), "")
    ).otherwise(text)


def numeric_conservation(original: Column, rewritten: Column) -> Column:
    """Reason a rewrite is unacceptable, or null when every number survived."""
    kept = numeric_tokens(rewritten)
    missing = F.array_distinct(
        F.filter(numeric_tokens(original), lambda t: ~F.array_contains(kept, t))
    )
    return (
        F.when(F.length(strip(rewritten)) == 0, F.lit("empty_transformed_text"))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("numeric_tokens_missing: "), F.array_join(missing, ", ")),
        )
        .otherwise(F.lit(None).cast("string"))
    )


def snippet(text: Column, n: int = 90) -> Column:
    """First ``n`` characters on one line, with an ellipsis when cut."""
    return F.concat(
        F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" ")),
        F.when(F.length(text) > n, F.lit("…")).otherwise(F.lit("")),
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def heading_markdown(level: Column, text: Column) -> Column:
    depth = F.when(F.coalesce(level, F.lit(0)) == 0, F.lit(1)).otherwise(level)
    return F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(4))), F.lit(" "), text)


def truthy(text: Column) -> Column:
    """The text, or null when it is null or empty."""
    return F.when(F.length(text) > 0, text)
