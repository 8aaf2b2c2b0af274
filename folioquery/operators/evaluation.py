"""Scoring of answers, page recall and the rows handed to judge metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.answers import is_na, score_answer
from folioquery.operators import models
from folioquery.operators.parents import METRIC_CONTEXT_CHARS, keep_prefix


def latest_answers(run: DataFrame, order: str) -> DataFrame:
    """One row per question of a run; a later duplicate wins.  Copies meet map-side."""
    others = [c for c in run.columns if c != "question"]
    return run.groupBy("question").agg(
        F.max_by(F.struct(*others), F.col(order)).alias("_r")
    ).select("question", "_r.*")


def baseline_answers(submission: DataFrame) -> DataFrame:
    """(question, final_answer, kind) from a submission that nests its answers."""
    return submission.select(F.explode("answers").alias("a")).select(
        F.col("a.question_text").alias("question"), F.col("a.value").alias("final_answer"),
        F.col("a.kind").alias("kind"),
    )


def score_run(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Join by question and score.

    ``predictions``: question, final_answer, items (its list form).  ``gold``:
    question, kind, golds.  Gold questions without a prediction are left out.
    """
    spoken = predictions.select(
        "question", F.coalesce("final_answer", F.lit("None")).alias("final_answer"), "items"
    )
    return spoken.join(gold, "question").select(
        "question", "kind", "final_answer", "golds",
        score_answer(F.col("final_answer"), F.col("items"), F.col("golds"), F.col("kind"))
        .alias("ok"),
        F.forall("golds", lambda g: is_na(g["text"])).alias("na"),
    )


def accuracy_slices(scored: DataFrame) -> DataFrame:
    """Correct, total and accuracy overall, per kind, and by whether gold is N/A."""
    sets = [[], [F.col("kind")], [F.col("na")]]
    which = F.grouping_id()
    return scored.groupingSets(sets, "kind", "na").agg(
        F.when(which == 3, "overall").when(which == 1, F.concat(F.lit("kind:"), "kind"))
        .when(F.col("na"), "na").otherwise("answerable").alias("slice"),
        F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"),
        F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("accuracy"),
    ).drop("kind", "na")


def run_counters(answers: DataFrame) -> DataFrame:
    """Answered, not available and failed rows of a run."""
    return answers.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("final_answer") == "N/A").alias("n_na"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
    )


# ---- page recall ----------------------------------------------------------------

def split_reference(ref: Column) -> tuple[Column, Column]:
    """``sha1:page`` at its last colon."""
    return (
        F.regexp_extract(ref, r"(?s)^(.*):[^:]*$", 1),
        F.regexp_extract(ref, r"([^:]*)$", 1).cast("int"),
    )


def usable_pools(pools: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pools whose references all lie in indexed documents; a broken pool goes as a whole.

    ``pools``: question_id, pool_no, doc_id, page.
    """
    known = indexed.select("doc_id").distinct().withColumn("_known", F.lit(True))
    checked = pools.join(known, "doc_id", "left")
    whole = checked.groupBy("question_id", "pool_no").agg(
        F.bool_and(F.coalesce("_known", F.lit(False))).alias("_whole")
    ).where("_whole")
    return pools.join(whole.drop("_whole"), ["question_id", "pool_no"])


def common_pools(pools: DataFrame, *indexed: DataFrame) -> DataFrame:
    """Pools that every one of several indexes can answer, so that their recalls compare."""
    for documents in indexed:
        pools = usable_pools(pools, documents)
    return pools


def page_order(candidates: DataFrame) -> DataFrame:
    """Distinct pages of each (question, document) numbered by first appearance.

    ``rank`` is anything that orders; it need not be dense.
    """
    first = candidates.groupBy("question_id", "doc_id", "page").agg(F.min("rank").alias("_first"))
    order = Window.partitionBy("question_id", "doc_id").orderBy("_first")
    return first.select(
        "question_id", "doc_id", "page", F.row_number().over(order).alias("page_rank")
    )


def recall_at(
    candidates: DataFrame, pools: DataFrame, ks: Sequence[int] = (5, 10, 20), page_offset: int = 0
) -> DataFrame:
    """Per question and k: mean over its pools of the share of wanted pages in the first k."""
    wanted = pools.select(
        "question_id", "pool_no", "doc_id", (F.col("page") + page_offset).alias("page")
    ).distinct()
    found = wanted.join(page_order(candidates), ["question_id", "doc_id", "page"], "left")
    per_pool = found.groupBy("question_id", "pool_no").agg(
        *[(F.count_if(F.col("page_rank") <= k) / F.count(F.lit(1))).alias(f"_{k}") for k in ks]
    )
    wide = per_pool.groupBy("question_id").agg(*[F.avg(f"_{k}").alias(f"_{k}") for k in ks])
    pairs = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("recall")) for k in ks
    ])
    return wide.select("question_id", F.inline(pairs))


def recall_ablation(recall_a: DataFrame, recall_b: DataFrame) -> DataFrame:
    """Mean recall of two arms over the same questions and their difference in points."""
    both = recall_a.withColumnRenamed("recall", "_a").join(
        recall_b.withColumnRenamed("recall", "_b"), ["question_id", "k"]
    )
    return both.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("_a"), 6).alias("recall_a"),
        F.round(F.avg("_b"), 6).alias("recall_b"),
        F.round((F.avg("_a") - F.avg("_b")) * 100, 4).alias("delta_points"),
    )


# ---- judge metrics ----------------------------------------------------------------

def judge_verdict(final_answer: Column, golds: Column, n_contexts: Column) -> Column:
    """``rated``, or why a row cannot be rated."""
    return (
        F.when(is_na(final_answer) | F.forall(golds, lambda g: is_na(g["text"])), "na")
        .when(n_contexts == 0, "no_contexts").otherwise("rated")
    )


def judge_rows(
    answers: DataFrame, gold: DataFrame, contexts: DataFrame, cap: int = METRIC_CONTEXT_CHARS
) -> DataFrame:
    """One row per ratable question with its contexts cut to ``cap`` characters.

    ``contexts``: question, ordinal, text.
    """
    kept = keep_prefix(contexts, ["question"], "ordinal", F.length("text"), cap, keep_first=True)
    lists = kept.groupBy("question").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]
        ).alias("retrieved_contexts")
    )
    rows = answers.join(gold, "question").join(lists, "question", "left")
    n_contexts = F.coalesce(F.size("retrieved_contexts"), F.lit(0))
    verdict = judge_verdict(F.col("final_answer"), F.col("golds"), n_contexts)
    return rows.where(verdict == "rated").select(
        F.col("question").alias("user_input"), "retrieved_contexts",
        F.col("final_answer").alias("response"),
        F.element_at("golds", 1)["text"].alias("reference"),
    )


def judge_counts(answers: DataFrame, gold: DataFrame, contexts: DataFrame) -> DataFrame:
    """How many aligned rows can be rated and how many fall out for which reason."""
    n = contexts.groupBy("question").agg(F.count(F.lit(1)).alias("_n"))
    rows = answers.join(gold, "question").join(n, "question", "left")
    verdict = judge_verdict(F.col("final_answer"), F.col("golds"), F.coalesce("_n", F.lit(0)))
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def rate_answers(
    rows: DataFrame, judge: models.Model,
    metrics: Sequence[str] = ("faithfulness", "answer_relevancy", "context_precision"), **calls,
) -> DataFrame:
    """Judge metrics of prepared rows; one that could not be computed is null."""
    asked = models.ask(
        rows, judge, ["user_input", "retrieved_contexts", "response", "reference"],
        models.check_object, **calls,
    )
    # read as strings: a mark may be a number, NaN, a number in quotes, or anything else, which is no mark
    marks = F.from_json("outcome.reply", ", ".join(f"`{m}` string" for m in metrics))
    return asked.withColumn("_marks", marks).select(
        *rows.columns, *[F.col("_marks").getField(m).try_cast("double").alias(m) for m in metrics]
    )


def judge_report(
    answers: DataFrame, gold: DataFrame, contexts: DataFrame, judge: models.Model,
    metrics: Sequence[str] = ("faithfulness", "answer_relevancy", "context_precision"), cap: int = METRIC_CONTEXT_CHARS, **calls,
) -> DataFrame:
    """Rows and metric means of every verdict and, as ``all``, of the aligned rows together, in one aggregate.

    A metric that is missing or not a number counts in no mean and in no ``n_<metric>``.
    """
    rated = rate_answers(judge_rows(answers, gold, contexts, cap), judge, metrics, **calls)
    n = contexts.groupBy("question").agg(F.count(F.lit(1)).alias("_n"))
    verdict = judge_verdict(F.col("final_answer"), F.col("golds"), F.coalesce("_n", F.lit(0)))
    rows = answers.join(gold, "question").join(n, "question", "left").select("question", verdict.alias("verdict")).join(
        rated.select(F.col("user_input").alias("question"), *metrics), "question", "left"
    )
    known = {m: F.when(~F.isnan(m), F.col(m)) for m in metrics}
    return rows.rollup("verdict").agg(
        F.grouping("verdict").alias("_all"), F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{m}") for m, c in known.items()], *[F.avg(c).alias(m) for m, c in known.items()],
    ).withColumn("verdict", F.when(F.col("_all") == 1, "all").otherwise(F.col("verdict"))).drop("_all")


def metric_means(rated: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the rows where it could be computed."""
    return rated.agg(*[
        F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics
    ])


def wrong_answers(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first wrong rows for a report, by question."""
    return scored.where(~F.col("ok")).orderBy("question").limit(n)
