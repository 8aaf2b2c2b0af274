"""Questions to answers, for all questions at once.

A question about one report is one task; a comparative question becomes one
numeric task per report and is put together afterwards.  Every step is a join,
window or aggregation over the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.answers import KINDS
from folioquery.functions.text import token_truncate, truthy
from folioquery.operators import fusion, lexical, models, parents, rerank, vectors
from folioquery.operators.enrichment import embed_texts
from folioquery.operators.routing import dispatch
from folioquery.sources.tables import shuffled, stage

RERANK_TOKEN_CAP = 1500
ANSWER_COLUMNS = (
    "question_id", "question", "kind", "doc_ids", "final_answer", "reasoning_summary",
    "relevant_pages", "references", "contexts", "sub_answers", "error",
)
_REFERENCES = "array<struct<pdf_sha1:string,page_index:int>>"


@dataclass(frozen=True)
class Models:
    ranker: models.Model = field(default_factory=models.OverlapRanker)
    answerer: models.Model = field(default_factory=models.ExtractiveAnswerer)
    rephraser: models.Model = field(default_factory=models.PerReportRephraser)
    combiner: models.Model = field(default_factory=models.FirstAnswerCombiner)
    embedder: object = field(default_factory=models.HashingEmbedder)


@dataclass(frozen=True)
class Options:
    k: int = 30
    vector_weight: float = fusion.VECTOR_WEIGHT
    candidates: int = fusion.TOP_N
    top_n: int = rerank.TOP_N
    weak_threshold: float = rerank.WEAK_THRESHOLD
    max_chars: int = parents.MAX_CONTEXT_CHARS


def sub_question(sub_questions: Column, doc_id: Column, position: Column, question: Column) -> Column:
    """The sub-question keyed by the report, else the one at its position, else a default.

    Positions count the sub-questions in sorted order, as models may use other keys.
    """
    by_position = F.try_element_at(F.array_sort(F.map_values(sub_questions)), position + 1)
    return F.coalesce(
        truthy(F.try_element_at(sub_questions, doc_id)), by_position,
        F.concat(F.lit("For "), doc_id, F.lit(", "), question),
    )


def comparative_tasks(questions: DataFrame, model: models.Model) -> DataFrame:
    """One numeric task per report of each comparative question."""
    # Rephrasing is not tried again: a failure is the failure of the question.
    asked = models.ask(
        questions.select("question_id", "question", "doc_ids"), model, ["question", "doc_ids"],
        models.check_object, retries=1,
    )
    subs = F.from_json("outcome.reply", "map<string,string>")
    return asked.select(
        "question_id", "question", F.col("outcome.error").alias("_error"), subs.alias("_subs"),
        F.posexplode("doc_ids").alias("position", "doc_id"),
    ).select(
        "question_id", "doc_id", "position",
        sub_question(F.col("_subs"), F.col("doc_id"), F.col("position"), F.col("question"))
        .alias("question"),
        F.lit("number").alias("kind"), "_error",
    )


def rank_candidates(
    candidates: DataFrame, model: models.Model, top_n: int = rerank.TOP_N, retries: int = 3
) -> DataFrame:
    """Model relevance in requests of ten blocks; a failed request rates its blocks 0."""
    candidates = stage(candidates, "candidates")
    block = F.struct("rank", token_truncate(F.col("text"), RERANK_TOKEN_CAP).alias("text"))
    requests = rerank.with_batches(candidates).groupBy("task_id", "question", "batch_no").agg(
        F.array_sort(F.collect_list(block)).alias("blocks")
    ).withColumn("texts", F.transform("blocks", lambda b: b["text"]))
    numbered = F.transform(
        "texts",
        lambda t, i: F.concat(F.lit("Block "), (i + 1).cast("string"), F.lit(':\n"""\n'), t,
                              F.lit('\n"""')),
    )
    prompt = F.concat(
        F.lit('Question: "'), F.col("question"), F.lit('"\n\n'), F.array_join(numbered, "\n\n---\n\n"),
        F.lit("\n\nRate each of the "), F.size("texts").cast("string"), F.lit(" blocks, in order."),
    )
    asked = models.ask(
        requests.withColumn("prompt", prompt), model, ["question", "texts", "prompt"],
        models.check_rankings, retries=retries,
    )
    ratings = "array<struct<reasoning:string,relevance_score:double>>"
    # Without a reply the list is empty, and every block of the request still gets a row.
    rates = F.coalesce(
        F.from_json("outcome.reply", f"struct<block_rankings:{ratings}>")["block_rankings"],
        F.array().cast(ratings),
    )
    scores = asked.select(
        "task_id", F.inline(F.arrays_zip(
            F.transform("blocks", lambda b: b["rank"]).alias("rank"),
            F.transform("blocks", lambda b: b["text"]).alias("_t"), rates.alias("r"),
        )),
    ).select(
        "task_id", "rank", F.coalesce("r.relevance_score", F.lit(0.0)).alias("relevance_score"),
        F.coalesce("r.reasoning", F.lit("no rating")).alias("reasoning"),
    )
    return rerank.combine_rankings(candidates.join(shuffled(scores), ["task_id", "rank"]), ["task_id"], top_n=top_n)


def answer_tasks(
    tasks: DataFrame, chunks: DataFrame, pages: DataFrame, embeddings: DataFrame,
    fingerprints: DataFrame, with_models: Models, options: Options = Options(),
) -> DataFrame:
    """Answer, valid pages, citations and contexts of every (task_id, doc_id, question, kind)."""
    tasks = tasks.withColumn(
        "_bad_kind",
        F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), "kind")),
    )
    embedded = embed_texts(
        tasks.select(F.col("doc_id").alias("route"), F.col("task_id").alias("question_id"), F.col("question").alias("text")),
        "text", with_models.embedder,
    )
    # A question without a vector is answered by its error; it is neither searched nor asked.
    tasks = tasks.join(
        shuffled(embedded.select(F.col("question_id").alias("task_id"), F.col("embedding_error").alias("_no_vector"))),
        "task_id", "left",
    )
    # Only the reports that were asked about are read further.
    asked_docs = tasks.select("doc_id").distinct()
    corpus = stage(
        chunks.join(asked_docs, "doc_id", "left_semi").select(
            F.col("doc_id").alias("route"), "chunk_id", "page", "text"
        ),
        "corpus",
    )
    asked = embedded.where(F.col("embedding_error").isNull()).drop("embedding_error")
    index = lexical.build_index(corpus)
    lexical_hits = lexical.bm25_topk(index, asked.drop("embedding"), options.k)
    chunk_vectors = embeddings.join(asked_docs, "doc_id", "left_semi").withColumnRenamed(
        "doc_id", "route"
    )
    vector_hits = vectors.cosine_topk(chunk_vectors, asked, options.k)
    fused = fusion.fuse_hits(vector_hits, lexical_hits, options.vector_weight, options.candidates)
    candidates = (
        fused.join(shuffled(corpus), ["route", "chunk_id"])
        .withColumnsRenamed({"question_id": "task_id", "route": "doc_id"})
        .join(shuffled(tasks.select("task_id", "question")), "task_id")
    )
    ranked = rank_candidates(candidates, with_models.ranker, options.top_n)
    evidence = ranked.groupBy("task_id").agg(
        rerank.weak_evidence(F.col("relevance_score"), options.weak_threshold).alias("weak")
    )
    whole_pages = parents.parent_pages(
        ranked.withColumn("rank", F.col("rerank")), pages, ["task_id"]
    )
    kept = parents.keep_prefix(
        whole_pages, ["task_id"], "page_rank", F.length("text"), options.max_chars
    )
    contexts = kept.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("page_rank", "page", "text"))).alias("_c")
    ).select(
        "task_id", F.transform("_c", lambda c: c["page"]).alias("pages"),
        F.transform("_c", lambda c: c["text"]).alias("contexts"),
    )
    blocks = F.zip_with(
        "pages", "contexts",
        lambda p, t: F.concat(F.lit("Page "), p.cast("string"), F.lit(':\n"""\n'), t, F.lit('\n"""')),
    )
    ready = (
        tasks.join(shuffled(contexts), "task_id", "left").join(shuffled(evidence), "task_id", "left")
        .withColumns({
            "pages": F.coalesce("pages", F.array().cast("array<int>")),
            "contexts": F.coalesce("contexts", F.array().cast("array<string>")),
            "weak": F.coalesce("weak", F.lit(options.weak_threshold > 0)),
        })
        .withColumn("context", F.array_join(blocks, "\n\n---\n\n"))
        .withColumn("_refused", F.coalesce("_bad_kind", "_no_vector").isNotNull())
    )
    replies = models.ask(
        ready, with_models.answerer, ["question", "kind", "context", "pages", "weak"],
        models.check_answer, skip="_refused",
    )
    reply = F.col("outcome.reply")
    cited = F.from_json(F.get_json_object(reply, "$.relevant_pages"), "array<int>")
    answered = replies.join(fingerprints.select("doc_id", "sha1"), "doc_id", "left").withColumn(
        "relevant_pages", parents.valid_pages(cited, F.col("pages"))
    )
    return answered.select(
        *[c for c in tasks.columns if c not in ("_bad_kind", "_no_vector")],
        F.coalesce(F.get_json_object(reply, "$.final_answer"), F.lit("N/A")).alias("final_answer"),
        F.get_json_object(reply, "$.reasoning_summary").alias("reasoning_summary"),
        F.coalesce("relevant_pages", F.array().cast("array<int>")).alias("relevant_pages"),
        F.coalesce(
            parents.references(F.col("relevant_pages"), F.col("sha1")).cast(_REFERENCES),
            F.array().cast(_REFERENCES),
        ).alias("references"),
        "contexts", F.coalesce("_bad_kind", "_no_vector", F.col("outcome.error")).alias("error"),
    )


def _finish(df: DataFrame) -> DataFrame:
    """Failed questions answer N/A, say why, and lose their evidence."""
    failed = F.col("error").isNotNull()
    return df.withColumns({
        "final_answer": F.when(failed, "N/A").otherwise(F.col("final_answer")),
        "reasoning_summary": F.when(failed, F.concat(F.lit("[ERROR] "), "error"))
        .otherwise(F.col("reasoning_summary")),
        "relevant_pages": F.when(failed, F.array().cast("array<int>"))
        .otherwise(F.col("relevant_pages")),
        "references": F.when(failed, F.array().cast(_REFERENCES)).otherwise(F.col("references")),
    }).select(*ANSWER_COLUMNS)


def answer_questions(
    questions: DataFrame, chunks: DataFrame, pages: DataFrame, embeddings: DataFrame,
    fingerprints: DataFrame, with_models: Models = Models(), options: Options = Options(),
) -> DataFrame:
    """Answers of routed questions (question_id, question, kind, doc_ids)."""
    questions = questions.withColumn("_how", dispatch(F.col("doc_ids")))
    single = questions.where(F.col("_how") == "single").select(
        "question_id", F.element_at("doc_ids", 1).alias("doc_id"), F.lit(0).alias("position"),
        "question", "kind", F.lit(None).cast("string").alias("_error"),
    )
    comparative = questions.where(F.col("_how") == "comparative")
    tasks = single.unionByName(comparative_tasks(comparative, with_models.rephraser)).withColumn(
        "task_id", F.concat_ws("/", F.col("question_id").cast("string"), F.col("position"))
    )
    done = answer_tasks(
        stage(tasks, "tasks"), chunks, pages, embeddings, fingerprints, with_models, options
    ).withColumn("error", F.coalesce("_error", "error"))
    done = stage(done, "answers")

    nothing = F.lit(None).cast("map<string,string>")
    one = done.join(shuffled(single.select("question_id")), "question_id", "left_semi").join(
        shuffled(questions.select("question_id", "doc_ids")), "question_id"
    ).withColumn("sub_answers", nothing)

    parts = F.array_sort(F.collect_list(F.struct(
        "position", "doc_id", "final_answer", "reasoning_summary", "relevant_pages", "references",
        "contexts", "error",
    )))
    gathered = done.join(
        shuffled(comparative.select("question_id", F.col("question").alias("_q"), F.col("kind").alias("_k"),
                                    "doc_ids")),
        "question_id",
    ).groupBy("question_id", "_q", "_k", "doc_ids").agg(parts.alias("p"))
    brief = F.map_from_entries(F.transform("p", lambda a: F.struct(
        a["doc_id"],
        F.struct(
            a["final_answer"].alias("final_answer"),
            F.coalesce(a["reasoning_summary"], F.lit("")).alias("reasoning_summary"),
            a["relevant_pages"].alias("pages"),
        ),
    )))
    combined = models.ask(
        gathered.select(
            "question_id", F.col("_q").alias("question"), F.to_json(brief).alias("sub_answers"),
            F.exists("p", lambda a: a["error"].isNotNull()).alias("_refused"),
        ),
        with_models.combiner, ["question", "sub_answers"], models.check_object, retries=1, skip="_refused",
    ).select("question_id", "outcome")
    reply = F.col("outcome.reply")
    many = gathered.join(shuffled(combined), "question_id").select(
        "question_id", F.col("_q").alias("question"), F.col("_k").alias("kind"), "doc_ids",
        F.coalesce(F.get_json_object(reply, "$.final_answer"), F.lit("N/A")).alias("final_answer"),
        F.coalesce(F.get_json_object(reply, "$.reasoning_summary"), F.lit(""))
        .alias("reasoning_summary"),
        F.array().cast("array<int>").alias("relevant_pages"),
        F.flatten(F.transform("p", lambda a: a["references"])).alias("references"),
        F.flatten(F.transform("p", lambda a: a["contexts"])).alias("contexts"),
        F.map_from_entries(F.transform("p", lambda a: F.struct(a["doc_id"], a["final_answer"])))
        .alias("sub_answers"),
        F.coalesce(
            F.get(F.filter(F.transform("p", lambda a: a["error"]), lambda e: e.isNotNull()), F.lit(0)),
            F.col("outcome.error"),
        ).alias("error"),
    )
    none = questions.where(F.col("_how") == "unanswerable").select(
        "question_id", "question", "kind", "doc_ids", F.lit("N/A").alias("final_answer"),
        F.lit("no indexed report is named in the question").alias("reasoning_summary"),
        F.array().cast("array<int>").alias("relevant_pages"),
        F.array().cast(_REFERENCES).alias("references"),
        F.array().cast("array<string>").alias("contexts"), nothing.alias("sub_answers"),
        F.lit(None).cast("string").alias("error"),
    )
    return (
        _finish(one.select(*ANSWER_COLUMNS))
        .unionByName(_finish(many.select(*ANSWER_COLUMNS)))
        .unionByName(none.select(*ANSWER_COLUMNS))
    )
