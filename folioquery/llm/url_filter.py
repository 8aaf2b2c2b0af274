"""URL filter: host and path rules, and a linear model on character n-grams for the rest.

Rules decide where they fit: a rule names a host, which covers its subdomains, and the
start of a path; the longest fitting rule wins. Every other URL is judged by a logistic
regression on hashed character n-grams of host and path, trained on a small labelled
table of URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed by the model's empty input (score of the intercept is below one
half). Repeated rows get equal verdicts. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import slices

#: (verdict, rule).
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
BUCKETS = 1 << 13
SIZES = (3, 4, 5)
EPOCHS = 300
RATE = 0.5
L2 = 1e-4

#: The labelled table: words of hosts, each with a sort of site; hosts and paths are formed by rule below.
BLOCKED_WORDS = (
    "casino", "poker", "slots", "jackpot", "free-bets", "betting", "roulette", "lotto-win", "cheap-pills", "viagra",
    "pharmacy-deal", "weight-loss-pill", "replica-watch", "payday-loan", "fast-cash", "crypto-giveaway", "xxx", "porn",
    "sex-cam", "escort", "hot-singles", "adult-video", "ads-track", "ad-server", "click-track", "pop-ads", "banner-ads",
    "spam", "malware", "warez", "crack-keygen", "torrent-free", "free-download", "phish-login", "win-prize", "casino-win",
)
ALLOWED_WORDS = (
    "news", "library", "university", "school", "research", "museum", "weather", "science", "history", "docs",
    "developer", "journal", "city-council", "hospital", "garden", "recipes", "travel-guide", "books", "music-review",
    "sports-daily", "chess-club", "open-data", "archive", "wiki", "forum", "therest", "ththin", "tionble", "thering",
    "herand", "ingother", "theron", "thather", "onening", "andthe", "ertion",
)
ENDINGS = (".org", ".net", ".info", ".example.org", ".example.net", ".example.com")
PATHS = ("/en/1234", "/de/77.html", "/fr/5/", "/es/901", "/index.html", "/articles/2020/05/a-title", "/")


def labelled_urls() -> list[tuple[str, str, int]]:
    """host, path, label (1: block): every word with some endings and paths."""
    rows = []
    for label, names in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, (word, ending) in enumerate(product(names, ENDINGS)):
            prefix = ("", "www.", "m.", "blog.")[i % 4]
            rows.append((prefix + word + ending, PATHS[i % len(PATHS)], label))
    return rows


def ngrams(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of host and path; empty for an empty host and path."""
    if not host and not path:
        return np.zeros(0, np.int64)
    found = set()
    for tag, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            found.update(tag + part[i : i + n] for i in range(len(part) - n + 1))
    return np.array([zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in found], np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    intercept: float

    def block(self, host: str, path: str) -> float:
        """Probability that a URL should be blocked."""
        grams = ngrams(host, path)
        z = self.intercept + (self.weights[grams].sum() / len(grams) ** 0.5 if len(grams) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(rows: list[tuple[str, str, int]]) -> UrlModel:
    """Logistic regression by full-batch gradient descent on (host, path, label)."""
    grams = [ngrams(h, p) for h, p, _ in rows]
    x = np.zeros((len(rows), BUCKETS))
    for i, g in enumerate(grams):
        np.add.at(x[i], g, 1 / max(1, len(g)) ** 0.5)
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    y = np.array([label for *_, label in rows], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= RATE * 20 * (x.T @ (p - y) / len(y) + L2 * w)
        b -= RATE * (p - y).mean()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    # URLs without any trait of the table are allowed
    return UrlModel(weights, min(b, -0.5))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A to Z lower-cased, and path up to a query or fragment; empty without ://."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row."""

    @F.arrow_udf("double")
    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        out = [model.block(h, p) for a, b in zip(slices(host), slices(path), strict=True) for h, p in zip(a, b, strict=True)]
        return pa.array(out, pa.float64())

    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parted.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score("host", "path").alias("block_score")
    ).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
