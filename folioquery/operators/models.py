"""Model calls as a DataFrame stage: validated replies, retries, one row in one row out.

A model is any picklable object with ``reply(request: dict) -> str`` that returns
JSON.  The request holds the chosen columns of the row.  Calls happen in Arrow
batches inside the tasks; how many run at once is the number of partitions times the
size of a task's pool.  ``ask_durably`` appends the replies of every finished batch to a
log, so a run that failed goes on where it stopped; ``compact_replies`` keeps the log short.
"""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators.slices import frame_slices
from folioquery.sources.stages import read_stage, write_stage
from folioquery.sources.tables import stage

OUTCOME = "struct<reply:string,error:string,attempts:int,tokens_in:bigint,tokens_out:bigint>"


class Model(Protocol):
    def reply(self, request: dict) -> str: ...


@dataclass(frozen=True)
class ModelConfig:
    """Address of a real endpoint; the key is read where the call is made, never in a plan."""

    base_url: str
    model: str
    key_variable: str
    options: dict[str, Any] = field(default_factory=dict)

    def key(self) -> str:
        import os

        value = os.environ.get(self.key_variable, "")
        if not value:
            raise RuntimeError(f"{self.key_variable} is not set")
        return value


# ---- reply checks: each raises ValueError on a malformed reply ------------------------


def _need(condition: bool, what: str) -> None:
    if not condition:
        raise ValueError(what)


def _texts(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(v, str) for v in value)


def check_blocks(reply: dict, request: dict) -> None:
    blocks = reply.get("information_blocks")
    _need(isinstance(blocks, list), "information_blocks must be a list")
    for b in blocks:
        _need(
            isinstance(b, dict)
            and all(isinstance(b.get(k), str) for k in ("subject_core_entity", "information_block")),
            "a block needs subject_core_entity and information_block",
        )
    for name in ("subject_core_entities_list", "relevant_headers_list"):
        _need(_texts(reply.get(name, [])), f"{name} must be a list of strings")


def check_rankings(reply: dict, request: dict) -> None:
    ranks = reply.get("block_rankings")
    _need(isinstance(ranks, list), "block_rankings must be a list")
    _need(len(ranks) == len(request["texts"]), f"{len(ranks)} rankings for {len(request['texts'])}")
    for r in ranks:
        score = r.get("relevance_score") if isinstance(r, dict) else None
        _need(
            isinstance(score, (int, float)) and not isinstance(score, bool) and 0 <= score <= 1
            and isinstance(r.get("reasoning"), str),
            "a ranking needs reasoning and a relevance_score in [0, 1]",
        )


def check_rewrite(reply: dict, request: dict) -> None:
    _need(isinstance(reply.get("transformed_text"), str), "transformed_text must be a string")


def check_answer(reply: dict, request: dict) -> None:
    value, kind = reply.get("final_answer"), request["kind"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {
        "name": isinstance(value, str),
        "names": isinstance(value, str) or _texts(value),
        "number": isinstance(value, str) or number,
        "boolean": isinstance(value, bool) or value == "N/A",
    }
    _need(fits.get(kind, False), f"final_answer does not fit kind {kind!r}")
    for name in ("step_by_step_analysis", "reasoning_summary"):
        _need(isinstance(reply.get(name), str), f"{name} must be a string")
    pages = reply.get("relevant_pages")
    _need(
        isinstance(pages, list) and all(isinstance(p, int) for p in pages),
        "relevant_pages must be a list of integers",
    )


def check_object(reply: dict, request: dict) -> None:
    """Any JSON object will do."""


def ask(
    df: DataFrame, model: Model, request: Sequence[str], check: Callable[[dict, dict], None],
    out: str = "outcome", retries: int = 3, backoff_seconds: float = 0.0, pool: int = 1,
    skip: str | None = None,
) -> DataFrame:
    """Add the outcome of one model call per row.

    ``pool`` calls of a task run at once.  Rows whose boolean column ``skip`` is true are
    not asked: their outcome holds no reply, no error and no attempt.

    A malformed reply or an exception is tried again, waiting longer each time;
    after the last try the row carries the error and the job goes on.  Usage is
    returned with the row, so a retried task does not count twice.  The result is a
    stage table: recomputing a plan never repeats a paid call.
    """
    return stage(_asked(df, model, request, check, out, retries, backoff_seconds, pool, skip), "model")


def ask_durably(
    df: DataFrame, keys: Sequence[str], model: Model, request: Sequence[str], check: Callable[[dict, dict], None],
    path: str, batches: int = 16, out: str = "outcome", retries: int = 3, backoff_seconds: float = 0.0, pool: int = 1,
) -> DataFrame:
    """``ask`` in batches that are committed one by one under ``path``, a folder that names the run.

    A later call with the same path asks only rows whose keys have no reply yet: finished
    batches are kept when a run dies, and rows that carry an error are asked again.
    Returns the rows of ``df`` with their outcome.
    """
    have = latest_replies(df.sparkSession, path, keys, out)
    todo = df if have is None else df.join(have.where(F.col(f"{out}.error").isNull()).select(*keys), list(keys), "left_anti")
    todo = stage(todo.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(batches))), "to-ask")
    for part in sorted(r[0] for r in todo.select("_part").distinct().collect()):
        rows = todo.where(F.col("_part") == part).drop("_part")
        asked = _asked(rows, model, request, check, out, retries, backoff_seconds, pool, None)
        asked.select(*keys, out).write.parquet(f"{path}/commit={time.time_ns()}")
    replies = latest_replies(df.sparkSession, path, keys, out)
    if replies is None:
        return df.withColumn(out, F.lit(None).cast(OUTCOME))
    return df.join(replies.select(*keys, out), list(keys), "left")


def latest_replies(spark: SparkSession, path: str, keys: Sequence[str], out: str = "outcome") -> DataFrame | None:
    """(keys, outcome, calls, commit): the last reply of every key, else its last error, and its calls in all.

    Read from the compacted table, if there is one, and the commits after it.
    """
    try:
        log = spark.read.parquet(path).select(*keys, out, F.col(f"{out}.attempts").cast("long").alias("calls"), "commit")
    except AnalysisException:  # nothing was committed under this path
        return None
    try:
        compact = read_stage(spark, f"{path}-compact")
        # the commits up to this one are folders that are not read
        upto = compact.agg(F.max("upto")).first()[0]
        log = log.where(F.col("commit") > upto).unionByName(compact.drop("upto")) if upto is not None else log
    except AnalysisException:
        pass
    best = F.max_by(out, F.struct(F.col(f"{out}.error").isNull(), F.col("commit")))
    return log.groupBy(*keys).agg(best.alias(out), F.sum("calls").alias("calls"), F.max("commit").alias("commit"))


def compact_replies(spark: SparkSession, path: str, keys: Sequence[str], out: str = "outcome") -> None:
    """Replace the commits so far, for readers, by one row per key; writers may go on meanwhile."""
    replies = latest_replies(spark, path, keys, out)
    if replies is not None:
        upto = spark.read.parquet(path).agg(F.max("commit")).first()[0]
        write_stage(replies.where(F.col("commit") <= upto).withColumn("upto", F.lit(upto)), f"{path}-compact")


def _asked(
    df: DataFrame, model: Model, request: Sequence[str], check: Callable[[dict, dict], None], out: str, retries: int,
    backoff_seconds: float, pool: int, skip: str | None,
) -> DataFrame:
    if retries <= 0:
        raise ValueError("retries must be positive")
    names = list(request)
    not_asked = {"reply": None, "error": None, "attempts": 0, "tokens_in": 0, "tokens_out": 0}

    def once(values: dict) -> dict:
        error, used_in, used_out = None, 0, 0
        for attempt in range(1, retries + 1):
            try:
                reply = model.reply(values)
                usage = getattr(model, "usage", None)
                if usage is not None:
                    used = usage(values, reply)
                    used_in, used_out = used_in + used[0], used_out + used[1]
                parsed = json.loads(reply or "{}")
                _need(isinstance(parsed, dict), "the reply is not an object")
                check(parsed, values)
                return {"reply": reply, "error": None, "attempts": attempt,
                        "tokens_in": used_in, "tokens_out": used_out}
            except Exception as e:  # noqa: BLE001 - one row must not end the run
                error = f"{type(e).__name__}: {e}"
                time.sleep(backoff_seconds * attempt)
        return {"reply": None, "error": error, "attempts": retries,
                "tokens_in": used_in, "tokens_out": used_out}

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frame_slices(batches, names):
            asked = [
                {n: v.tolist() if hasattr(v, "tolist") else v for n, v in row.items()}
                for row in pdf[names].to_dict("records")
            ]
            passed_over = pdf[skip].tolist() if skip else [False] * len(asked)

            def outcome(r: dict, no: bool) -> dict:
                return not_asked if no else once(r)

            if pool > 1:
                with ThreadPoolExecutor(pool) as threads:
                    outcomes = list(threads.map(outcome, asked, passed_over))
            else:
                outcomes = list(map(outcome, asked, passed_over))
            yield pdf.assign(**{out: outcomes})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(call, f"{columns}, `{out}` {OUTCOME}")


def usage_totals(df: DataFrame, out: str = "outcome") -> DataFrame:
    return df.agg(
        F.sum(f"{out}.tokens_in").alias("tokens_in"), F.sum(f"{out}.tokens_out").alias("tokens_out"),
        F.count_if(F.col(f"{out}.error").isNotNull()).alias("n_failed"),
    )


# ---- deterministic stand-ins ------------------------------------------------------------

_WORD = re.compile(r"\d+(?:[.,]\d+)*|[a-z][a-z0-9]*")
_AMOUNT = re.compile(r"-?\d+(?:,\d{3})*(?:\.\d+)?")


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class OverlapRanker:
    """Relevance is the share of question words in a block, in steps of 0.1."""

    def reply(self, request: dict) -> str:
        asked = _words(request["question"]) or {""}
        shares = [len(asked & _words(t)) / len(asked) for t in request["texts"]]
        return json.dumps({"block_rankings": [
            {"reasoning": "word overlap", "relevance_score": math.floor(s * 10 + 0.5) / 10}
            for s in shares
        ]})


class DroppingRewriter:
    """Returns the text without the given characters; dropping a digit loses a number."""

    def __init__(self, characters: str = "") -> None:
        self.characters = characters

    def reply(self, request: dict) -> str:
        kept = request["text"].translate({ord(c): None for c in self.characters})
        return json.dumps({"transformed_text": kept})


class CellReader:
    """One information block per table row, cells joined by commas."""

    def reply(self, request: dict) -> str:
        rows = re.findall(r"<tr>(.*?)</tr>", request["html"], flags=re.S)
        lines = [", ".join(re.findall(r"<t[dh][^>]*>(.*?)</t[dh]>", r, flags=re.S)) for r in rows]
        return json.dumps({
            "subject_core_entities_list": [l.split(",")[0] for l in lines],
            "relevant_headers_list": [],
            "information_blocks": [
                {"subject_core_entity": l.split(",")[0], "information_block": l} for l in lines if l
            ],
        })


class ExtractiveAnswerer:
    """First amount or capitalized word of the context; N/A on weak evidence."""

    def reply(self, request: dict) -> str:
        context, kind = request["context"], request["kind"]
        amounts = _AMOUNT.findall(context)
        names = re.findall(r"[A-Z][a-z]+", context)
        value: Any = "N/A"
        if not request["weak"]:
            if kind == "boolean":
                value = True
            elif kind == "number" and amounts:
                value = float(amounts[0].replace(",", ""))
            elif kind == "names" and names:
                value = names[:2]
            elif kind == "name" and names:
                value = names[0]
        return json.dumps({
            "step_by_step_analysis": "stand-in", "reasoning_summary": "stand-in",
            "relevant_pages": list(request["pages"][:1]), "final_answer": value,
        })


class PerReportRephraser:
    """One sub-question per report."""

    def reply(self, request: dict) -> str:
        return json.dumps({d: f"{request['question']} ({d})" for d in request["doc_ids"]})


class FirstAnswerCombiner:
    """The first report that has an answer."""

    def reply(self, request: dict) -> str:
        subs = json.loads(request["sub_answers"])
        found = [d for d, a in subs.items() if a["final_answer"] != "N/A"]
        return json.dumps({
            "final_answer": found[0] if found else "N/A", "reasoning_summary": "stand-in"
        })


class HashingEmbedder:
    """Signed word counts in a fixed number of buckets."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        import xxhash

        out = []
        for i, text in enumerate(texts):
            vector = [0.0] * self.dims
            for w in _WORD.findall(text.lower()):
                h = xxhash.xxh64_intdigest(w)
                vector[h % self.dims] += 1.0 if h >> 63 else -1.0
            out.append((i, vector))
        return out


class TaggedImageReader:
    """Takes the class lines and the reading from ``<class lines>|<reading>`` as the image."""

    def reply(self, request: dict) -> str:
        if request.get("stage") == "classify":
            return json.dumps({"text": request["image"].split("|", 1)[0]})
        return json.dumps({"text": request["image"].split("|", 1)[1]})
