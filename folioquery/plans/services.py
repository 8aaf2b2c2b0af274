"""Registered queries: ingestion, model stages and question answering.

Models are the deterministic stand-ins, so most results can be stated in SQL.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioquery.functions.text import token_count
from folioquery.operators import answering, enrichment, evaluation, indexing, models, rerank, routing
from folioquery.operators.elements import convert_entries
from folioquery.operators.ingestion import ingest
from folioquery.plans import derived as D
from folioquery.plans import sqltext as S
from folioquery.plans.registry import ORACLES, query
from folioquery.plans.retrieval import HYBRID, hybrid_hits
from folioquery.plans.structure import document_chunks
from folioquery.session import ensure_checkpoint_dir
from folioquery.sources import html
from folioquery.sources.tables import stage, table, table_stream
from folioquery.streaming.ingest import attempts, dead_letters, retry_failed, run_ingest

# ---- ingestion ----------------------------------------------------------------------


@query("html_elements")
def html_elements(spark, folder):
    """Raw web pages through the HTML reader and the element conversion."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), html.html_entries(F.col("html")).alias("entries")
    )
    return convert_entries(pages)


def read_html_pages(content: bytes, n: int) -> list[str]:
    texts = [e["text"] or "" for e in html.page_entries(content.decode("utf-8"))]
    return ["\n".join(texts)]


def read_html_layout(content: bytes) -> list[dict]:
    return html.page_entries(content.decode("utf-8"))


def page_files(pages):
    return pages.select(
        F.col("url").alias("source"), F.col("page_id").alias("doc_id"),
        F.sha1("html").alias("sha1"), F.col("html").cast("binary").alias("content"),
    )


_INGESTED = """
SELECT page_id AS doc_id, url AS source,
  CASE WHEN page_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'accepted' END AS status
FROM pages"""


@query("ingest_pages", _INGESTED)
def ingest_pages(spark, folder):
    """Quality gate and parsing of the pages; labelled ones count as done."""
    results, _ = ingest(
        page_files(table(spark, folder, "pages")), table(spark, folder, "labels"),
        read_html_layout, read_html_pages,
    )
    return results.select("doc_id", "source", "status")


@query("stream_ingest_pages", _INGESTED)
def stream_ingest_pages(spark, folder):
    """The same as an incremental stream over the table's files."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    run_ingest(
        page_files(table_stream(spark, folder, "pages")), out, read_html_layout, read_html_pages,
        done=lambda: table(spark, folder, "labels").select("doc_id"),
    )
    return spark.read.parquet(f"{out}/results").select("doc_id", "source", "status")


def read_marked_layout(content: bytes) -> list[dict]:
    """A reader that fails on pages marked as torn."""
    if content.startswith(b"%torn"):
        raise ValueError("torn page")
    return read_html_layout(content)


@query("ingest_ledger", """
SELECT page_id AS doc_id, CASE WHEN page_id % 7 = 3 THEN 'rejected' WHEN page_id % 5 = 2 THEN 'failed' ELSE 'accepted' END AS status,
  CASE WHEN page_id % 7 = 3 THEN 'DOCUMENT_QUALITY_REJECTED' WHEN page_id % 5 = 2 THEN 'PDF_PARSE_FAILED' END AS error_code,
  CASE WHEN page_id % 7 <> 3 AND page_id % 5 = 2 THEN 3 ELSE 1 END AS tries,
  page_id % 7 = 3 OR page_id % 5 = 2 AS dead
FROM pages""")
def ingest_ledger(spark, folder):
    """All pages through the stream in two runs over one ledger, then the failed ones again until their tries are used up.

    Of the pages as they are given to the reader, some are damaged: those whose id leaves 3
    when divided by 7 have no readable character, others whose id leaves 2 by 5 are torn.
    """
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    pages = table(spark, folder, "pages")
    damaged = F.col("page_id") % 7 == 3
    given = pages.withColumn("html", F.when(damaged, F.lit("<p>\ue000\ue001\ue002\ue003</p>")).when(
        F.col("page_id") % 5 == 2, F.concat(F.lit("%torn"), "html")
    ).otherwise(F.col("html")))
    schema = given.schema
    for part, run in ((F.col("page_id") % 2 == 0, "one"), (F.coalesce(F.col("page_id") % 2 != 0, F.lit(True)), "two")):
        given.where(part).write.mode("append").parquet(f"{out}/inbox")
        stream = page_files(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{out}/inbox"))
        run_ingest(stream, out, read_marked_layout, read_html_pages, stall_limit=3)
    retry_failed(page_files(given), out, read_marked_layout, read_html_pages)
    dead = dead_letters(spark, out).select("doc_id", F.lit(True).alias("dead"))
    return attempts(spark, out).join(dead, "doc_id", "left").select(
        "doc_id", "status", "error_code", F.col("tries").cast("int").alias("tries"), F.coalesce("dead", F.lit(False)).alias("dead")
    )


# ---- model stages -----------------------------------------------------------------------


def report_docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.col("source").alias("company"))


_CONTEXT = ORACLES["table_context"]


@query("table_prompts", f"""
WITH ctx AS ({_CONTEXT}), {S.ELEMENTS}
SELECT e.doc_id, e.table_id, 'Table from the annual report of ' || d.source || '.' || {S.NL} || {S.NL}
  || CASE WHEN c.before <> '' THEN 'Text before the table:' || {S.NL} || '\"\"\"' || c.before || '\"\"\"' || {S.NL} || {S.NL} ELSE '' END
  || CASE WHEN e.text <> '' THEN 'Caption: ' || e.text || {S.NL} ELSE '' END
  || 'Table:' || {S.NL} || '\"\"\"' || e.html || '\"\"\"'
  || CASE WHEN c.after <> '' THEN {S.NL} || {S.NL} || 'Text after the table:' || {S.NL} || '\"\"\"' || c.after || '\"\"\"' ELSE '' END
  || CASE WHEN length(e.html) > 12000 THEN {S.NL} || {S.NL} ||
     'The table is very large: group related rows, at most 40 compact blocks.' ELSE '' END AS prompt
FROM elements e JOIN ctx c USING (doc_id, table_id) JOIN documents d ON d.doc_id = e.doc_id
WHERE e.type = 'table'""")
def table_prompts(spark, folder):
    elements = D.report_elements(spark, folder)
    tables = elements.where(F.col("type") == "table").select(
        "doc_id", "table_id", "html", F.col("text").alias("caption")
    )
    return enrichment.table_requests(tables, elements, report_docs(spark, folder)).select(
        "doc_id", "table_id", "prompt"
    )


@query("table_blocks", f"""
WITH {S.ELEMENTS}
SELECT doc_id, table_id, regexp_replace(html, '</?t[a-z]+>', '', 'g') AS block
FROM elements WHERE type = 'table'""")
def table_blocks(spark, folder):
    """Every pending table through the table stage."""
    elements = D.report_elements(spark, folder)
    tables = elements.where(F.col("type") == "table").select(
        "doc_id", "table_id", "html", F.col("text").alias("caption"),
        F.lit(None).cast(enrichment.SERIALIZED).alias("serialized"),
    )
    done = enrichment.serialize_tables(
        tables, elements, report_docs(spark, folder), models.CellReader()
    )
    blocks = enrichment.information_blocks(F.col("serialized"))
    return done.select("doc_id", "table_id", F.array_join(blocks, "|").alias("block"))


@query("picture_readings", f"""
WITH {S.ELEMENTS}
SELECT doc_id, idx, CASE WHEN length(text) % 2 = 0 THEN 'bar_chart' ELSE 'logo' END AS type,
  CASE WHEN length(text) % 2 = 0 THEN 'HAS_DATA' ELSE 'NO_DATA' END AS data,
  CASE WHEN length(text) % 2 = 0 THEN 'Values of ' || text ELSE '' END AS text
FROM elements WHERE type = 'picture'""")
def picture_readings(spark, folder):
    """Classification of all pictures, reading of those that carry data."""
    long_caption = F.length("text") % 2 == 0
    image = F.concat(
        F.when(long_caption, "TYPE: **Bar_Chart\nDATA: has_data").otherwise("type: logo\nDATA: none"),
        F.lit("|Values of "), F.col("text"),
    )
    elements = D.report_elements(spark, folder).withColumns({
        "img": F.when(F.col("type") == "picture", image),
        "vl": F.lit(None).cast("struct<type:string,data:string,text:string,img:string>"),
    })
    read = enrichment.read_pictures(elements, report_docs(spark, folder), models.TaggedImageReader())
    return read.where(F.col("type") == "picture").select(
        "doc_id", "idx", "vl.type", "vl.data", "vl.text"
    )


@query("chunk_rewrites", f"""
WITH pairs AS (
  SELECT doc_id, source, lang, text, replace(replace(text, '9', ''), '%', '') AS rewritten FROM documents
),
found AS (
  SELECT doc_id, {S.numbers('rewritten')} AS kept, unnest({S.numbers('text')}) AS tok,
    generate_subscripts({S.numbers('text')}, 1) AS pos FROM pairs
),
lost AS (SELECT doc_id, tok, min(pos) AS pos FROM found WHERE NOT list_contains(kept, tok) GROUP BY 1, 2),
reasons AS (SELECT doc_id, string_agg(tok, ', ' ORDER BY pos) AS toks FROM lost GROUP BY 1)
SELECT doc_id AS chunk_id,
  CASE WHEN lang = 'en' THEN CASE WHEN toks IS NULL THEN 'transformed' ELSE 'validation_failed' END END AS status,
  CASE WHEN lang = 'en' AND toks IS NOT NULL THEN 'numeric_tokens_missing: ' || toks END AS reason,
  md5(CASE WHEN lang = 'en' AND toks IS NULL THEN {S.strip('rewritten')} ELSE text END) AS text_hash,
  lang = 'en' AND toks IS NULL AS changed
FROM pairs LEFT JOIN reasons USING (doc_id)""")
def chunk_rewrites(spark, folder):
    """Documents as the chunks of their source; English ones are prose.

    The stand-in drops nines and percent signs, so some numbers are lost.
    """
    chunks = table(spark, folder, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text",
        F.when(F.col("lang") == "en", "content").otherwise("serialized_table").alias("type"),
        F.lit(0).alias("length_tokens"),
    )
    out = enrichment.rewrite_chunks(chunks, models.DroppingRewriter("9%"), "stand-in")
    return out.select(
        "chunk_id", F.col("transform.status").alias("status"),
        F.col("transform.reason").alias("reason"),
        F.md5(F.col("text").cast("binary")).alias("text_hash"),
        F.col("original_text").isNotNull().alias("changed"),
    )


@query("model_rerank", f"""
WITH {HYBRID},
cut AS (
  SELECT doc_id, CASE WHEN {S.tokens('text')} > 1500 THEN array_to_string(
    regexp_extract_all(text, '[ \\t\\n\\r]*(?:{S.TOKEN_PATTERN})')[1:1500], '') ELSE text END AS text
  FROM documents
),
asked_words AS (SELECT item_id AS question_id, list_distinct({S.lexical('text')}) AS w FROM benchmark),
rated AS (
  SELECT h.*, floor(len(list_intersect(a.w, {S.lexical("coalesce(c.text, '')")})) / len(a.w)::DOUBLE * 10 + 0.5) / 10 AS rel
  FROM hybrid h JOIN asked_words a USING (question_id) LEFT JOIN cut c ON c.doc_id = h.chunk_id
),
mixed AS (
  SELECT *, round(0.7::DECIMAL(2, 1) * rel::DECIMAL(7, 6) + 0.3::DECIMAL(2, 1) * score::DECIMAL(7, 4), 4)::DOUBLE
    AS combined_score FROM rated
)
SELECT question_id, chunk_id, rel AS relevance_score, combined_score, rerank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY combined_score DESC, rank) AS rerank
  FROM mixed) WHERE rerank <= 6""")
def model_rerank(spark, folder):
    """Hybrid candidates rated by the model stage in requests of ten."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    questions = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
    # a vector without a document stays a candidate, with an empty text
    cands = hybrid_hits(spark, folder).join(texts, "chunk_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    ).join(questions, "question_id")
    ranked = answering.rank_candidates(
        cands.withColumnRenamed("question_id", "task_id"), models.OverlapRanker()
    )
    return ranked.select(
        F.col("task_id").alias("question_id"), "chunk_id", "relevance_score", "combined_score",
        "rerank",
    )


@query("weak_evidence", f"""
WITH {HYBRID}
SELECT question_id, coalesce(max(coalesce(l.quality, 0)), 0) <= 0.5 AS weak
FROM hybrid h LEFT JOIN labels l ON l.doc_id = h.chunk_id GROUP BY 1""")
def weak_evidence(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return hybrid_hits(spark, folder).join(labels, "chunk_id", "left").groupBy("question_id").agg(
        rerank.weak_evidence(F.coalesce("quality", F.lit(0)).cast("double")).alias("weak")
    )


def conversation_chunks(spark, folder):
    """Conversations as reports of one chunk a turn."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("chunk_id"), "text",
        token_count(F.col("text")).alias("length_tokens"),
    )


@query("index_round_trip", """
SELECT 'c' || conv_id AS doc_id, CASE WHEN bool_or(trim(text) = '') THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN NOT bool_or(trim(text) = '') THEN count(*) END AS n_chunks,
  CASE WHEN NOT bool_or(trim(text) = '') THEN count(*) END AS n_vectors,
  CASE WHEN NOT bool_or(trim(text) = '') THEN 16 END AS dims
FROM conversations GROUP BY conv_id""")
def index_round_trip(spark, folder):
    """Conversations as reports, indexed in two runs and read back: the second run only skips."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    chunks = conversation_chunks(spark, folder)
    embedder = models.HashingEmbedder(16)
    first = stage(indexing.update_index(chunks, path, embedder, "hashing"), "first-run")
    indexing.update_index(chunks, path, embedder, "hashing")
    lexical_rows, vector_rows, meta = indexing.read_index(spark, path)
    n_chunks = lexical_rows.groupBy(F.col("route").alias("doc_id")).agg(F.count("*").alias("n_chunks"))
    n_vectors = vector_rows.groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    return first.select("doc_id", "status").join(n_chunks, "doc_id", "left").join(n_vectors, "doc_id", "left").join(
        meta.select("doc_id", "dims"), "doc_id", "left"
    )


_INDEXED = f"""
indexed AS (
  SELECT 'c' || conv_id AS doc_id, count(*) AS n, ('0x' || md5('c' || conv_id)[1:4])::INT % {indexing.BUCKETS} AS bucket
  FROM conversations GROUP BY conv_id HAVING NOT bool_or(trim(text) = '')
),
asked AS (SELECT * FROM indexed JOIN (SELECT DISTINCT 'c' || item_id AS doc_id FROM benchmark) USING (doc_id))"""


@query("index_lookup", f"""
WITH {_INDEXED},
rows_ AS (
  SELECT unnest(['lexical', 'vectors', 'meta']) AS part, doc_id, bucket, unnest([n, n, 1]) AS n FROM asked
)
SELECT part, count(DISTINCT doc_id) AS n_reports, sum(n)::BIGINT AS n_rows, count(DISTINCT bucket) AS n_files_read,
  (SELECT count(DISTINCT bucket) FROM indexed) AS n_files FROM rows_ GROUP BY part""")
def index_lookup(spark, folder):
    """Conversations as reports, of which those that share their number with a benchmark item are read back.

    A report's rows lie in one file of its bucket, so the files read are the buckets of the asked reports.
    """
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    indexing.update_index(conversation_chunks(spark, folder), path, models.HashingEmbedder(16), "hashing")
    asked = table(spark, folder, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("doc_id"))
    current = indexing.asked_reports(spark, path, asked)
    out = None
    for part, rows in zip(indexing.PARTS, indexing.read_index(spark, path, asked)):
        opened, everything = (indexing.opened_files(spark, path, part, c).agg(F.count("*")) for c in (current, None))
        row = rows.agg(
            F.count_distinct("route" if part == "lexical" else "doc_id").alias("n_reports"), F.count("*").alias("n_rows")
        ).select(F.lit(part).alias("part"), "*", opened.scalar().alias("n_files_read"), everything.scalar().alias("n_files"))
        out = row if out is None else out.unionByName(row)
    return out


class Moody:
    """A model that, until it is cured, answers no text of odd length; a reply tells the length."""

    def __init__(self, cured: bool):
        self.cured = cured

    def reply(self, request: dict) -> str:
        n = len(request["text"])
        if n % 2 and not self.cured:
            raise RuntimeError("no reply")
        return json.dumps({"length": n})


@query("durable_replies", """
SELECT conv_id, turn, length(text) AS reply_length, CASE WHEN length(text) % 2 = 1 THEN 3 ELSE 1 END::BIGINT AS calls, 'true' AS settled
FROM conversations WHERE role = 'user'""")
def durable_replies(spark, folder):
    """User turns asked of a model in three runs over one log, compacted between them.

    The first run gets no reply to texts of odd length after two tries, the second asks only
    those again, the third has nothing left to ask.
    """
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/replies-{uuid.uuid4().hex}"
    keys, turns = ["conv_id", "turn"], table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    models.ask_durably(turns, keys, Moody(False), ["text"], models.check_object, path, batches=2, retries=2)
    models.compact_replies(spark, path, keys)
    models.ask_durably(turns, keys, Moody(True), ["text"], models.check_object, path, batches=2, retries=2)
    before = models.latest_replies(spark, path, keys).agg(F.sum("calls")).first()[0]
    models.ask_durably(turns, keys, Moody(True), ["text"], models.check_object, path, batches=2)
    replies = models.latest_replies(spark, path, keys)
    return replies.select(
        *keys, F.get_json_object("outcome.reply", "$.length").cast("long").alias("reply_length"), "calls",
        F.lit(replies.agg(F.sum("calls")).first()[0] == before).cast("string").alias("settled"),
    )


class Grader:
    """A judge whose marks follow from what it is shown; some it gives as NaN, some not at all."""

    def reply(self, request: dict) -> str:
        n, question = len(request["retrieved_contexts"]), int(request["user_input"])
        marks = {"faithfulness": n / 8, "answer_relevancy": math.nan if question % 2 else 0.25}
        if question % 3:
            marks["context_precision"] = len(request["response"]) / 64
        return json.dumps(marks)


@query("judge_report", f"""
WITH cut AS (
  SELECT conv_id, count(*) FILTER (nth = 1 OR total <= {evaluation.METRIC_CONTEXT_CHARS}) AS n FROM (
    SELECT conv_id, sum(length(text)) OVER w AS total, row_number() OVER w AS nth FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id
),
judged AS (
  SELECT d.doc_id AS q, length(d.source) / 64 AS precision, coalesce(c.n, 0) AS n,
    CASE WHEN coalesce(l.quality = 0, false) OR d.lang = 'de' THEN 'na' WHEN c.n IS NULL THEN 'no_contexts' ELSE 'rated' END AS verdict
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN cut c ON c.conv_id = d.doc_id
),
marks AS (
  SELECT verdict, CASE WHEN verdict = 'rated' THEN n / 8 END AS f, CASE WHEN verdict = 'rated' AND q % 2 = 0 THEN 0.25 END AS r,
    CASE WHEN verdict = 'rated' AND q % 3 <> 0 THEN precision END AS p FROM judged
)
SELECT coalesce(verdict, 'all') AS verdict, count(*) AS n_rows, count(f) AS n_faithfulness, count(r) AS n_answer_relevancy,
  count(p) AS n_context_precision, round(avg(f), 6) AS faithfulness, round(avg(r)::DOUBLE, 6) AS answer_relevancy,
  round(avg(p), 6) AS context_precision
FROM marks GROUP BY ROLLUP (verdict)""")
def judge_report(spark, folder):
    """Documents as questions whose answer is their source, with the turns of the conversation of their number as contexts.

    Answers to documents of low quality are N/A, and so is the truth about German ones.
    """
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("question"), "lang", "source")
    low = table(spark, folder, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("question"), F.lit(True).alias("low"))
    answers = docs.join(low, "question", "left").select("question", F.when(F.col("low"), "N/A").otherwise(F.col("source")).alias("final_answer"))
    gold = docs.select("question", F.array(F.struct(F.when(F.col("lang") == "de", "N/A").otherwise(F.col("source")).alias("text"))).alias("golds"))
    contexts = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("question"), F.col("turn").alias("ordinal"), "text"
    )
    report = evaluation.judge_report(answers, gold, contexts, Grader())
    return report.withColumns({m: F.round(m, 6) for m in ("faithfulness", "answer_relevancy", "context_precision")})


# ---- question answering -------------------------------------------------------------------


@query("answer_questions")
def answer_questions(spark, folder):
    """Every benchmark passage asked of the reports it names, over all reports.

    The question with id i names report i, and those with an even i also report i + 1.
    """
    chunks, pages = document_chunks(spark, folder)
    name = F.concat(F.lit("report-"), F.col("doc_id").cast("string"))
    chunks, pages = (df.withColumn("doc_id", name) for df in (chunks, pages))
    docs = table(spark, folder, "documents").select(name.alias("doc_id"), F.col("doc_id").alias("nth"))
    metadata = docs.select(
        F.concat(F.lit("Company "), F.col("nth").cast("string"), F.lit(" Inc.")).alias("company"),
        F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.col("nth").alias("csv_ord"),
    )
    i = F.col("item_id")
    second = F.when(i % 2 == 0, F.concat(
        F.lit(" and Company "), (i + 1).cast("string"), F.lit(" Inc.")
    )).otherwise("")
    questions = table(spark, folder, "benchmark").select(
        i.alias("question_id"),
        F.concat(F.lit("For Company "), i.cast("string"), F.lit(" Inc."), second, F.lit(": "), "text")
        .alias("question"),
        F.when(i % 3 == 0, "number").when(i % 3 == 1, "boolean").otherwise("name").alias("kind"),
    )
    routed = routing.route_questions(questions, routing.vocabulary(metadata, chunks))
    asked = routed.select(F.explode("doc_ids").alias("doc_id")).distinct()
    vectors = enrichment.embed_chunks(
        chunks.join(asked, "doc_id", "left_semi"), models.HashingEmbedder()
    )
    complete, _ = enrichment.embedded_documents(vectors)
    fingerprints = docs.select("doc_id", F.sha1("doc_id").alias("sha1"))
    answers = answering.answer_questions(routed, chunks, pages, complete, fingerprints)
    return answers.select(
        "question_id", "kind", F.array_join("doc_ids", "|").alias("doc_ids"), "final_answer",
        F.to_json("relevant_pages").alias("relevant_pages"), F.size("references").alias("n_references"),
        F.size("contexts").alias("n_contexts"), "error",
    )


class AccountAnswerer:
    """Looks the account of the question up in the context."""

    def reply(self, request: dict) -> str:
        number = re.search(r"#(\d+)", request["question"])[1]
        page = re.search(rf"Page (\d+):\n\"\"\"\n[^\"]*#{number} holds (-?[\d.]+)", request["context"])
        return json.dumps({
            "step_by_step_analysis": "looked up", "reasoning_summary": "looked up",
            "relevant_pages": [int(page[1])] if page else [], "final_answer": float(page[2]) if page else "N/A",
        })


class PickyEmbedder(models.HashingEmbedder):
    """Cannot embed texts with a currency sign."""

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        if any("\u00a4" in t for t in texts):
            raise ValueError("cannot embed")
        return super().embed(texts)


@query("answer_chain", """
WITH suppliers AS (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS page, s_suppkey % 4 AS how
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
)
SELECT s_suppkey AS question_id,
  CASE how WHEN 0 THEN 'single' WHEN 1 THEN 'comparative' WHEN 2 THEN 'unanswerable' ELSE 'single' END AS route_kind,
  CASE how WHEN 0 THEN s_acctbal::DOUBLE END AS amount, CASE how WHEN 1 THEN lower(n_name) WHEN 0 THEN '' ELSE 'N/A' END AS answer,
  CASE how WHEN 0 THEN page END::INT AS first_page, CASE how WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_reports,
  CASE how WHEN 3 THEN 'ValueError: cannot embed' END AS error
FROM suppliers""")
def answer_chain(spark, folder):
    """Every supplier's account asked of the reports of nations, a title and a page to a supplier, through the whole chain.

    By its number a supplier's question names the nation's report, that and another one, none, or
    one in words that cannot be embedded: an answer, a comparison, N/A, and an error that costs no other question anything.
    """
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", F.lower("n_name").alias("doc_id"))
    suppliers = table(spark, folder, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("s_suppkey")) + 1
    text = F.concat("s_name", F.lit(" holds "), F.col("s_acctbal").cast("double").cast("string"), F.lit(" in the account"))
    titles = nation.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Accounts of "), "n_name").alias("text"))
    chunks = stage(titles.unionByName(suppliers.select("doc_id", page.alias("page"), text.alias("text"))).select(
        "doc_id", (F.col("page") - 1).cast("long").alias("chunk_id"), "page", "text", token_count(F.col("text")).alias("length_tokens"),
    ), "accounts")
    metadata = nation.select(
        F.col("n_name").alias("company"), F.concat(F.lit("raw/"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.col("n_nationkey").cast("long").alias("csv_ord"),
    )
    other = nation.select((F.pmod(F.col("n_nationkey") - 1, F.lit(25))).alias("s_nationkey"), F.col("n_name").alias("other"))
    how = F.col("s_suppkey") % 4
    asked = (
        F.when(how == 0, F.concat(F.lit("How much does "), "s_name", F.lit(" of "), "n_name", F.lit(" hold?")))
        .when(how == 1, F.concat(F.lit("Who knows "), "s_name", F.lit(", "), "n_name", F.lit(" or "), "other", F.lit("?")))
        .when(how == 2, F.concat(F.lit("How much does "), "s_name", F.lit(" hold?")))
        .otherwise(F.concat(F.lit("How much \u00a4 does "), "s_name", F.lit(" of "), "n_name", F.lit(" hold?")))
    )
    questions = suppliers.join(other, "s_nationkey").select(
        F.col("s_suppkey").alias("question_id"), asked.alias("question"), F.lit("number").alias("kind")
    )
    routed = stage(routing.route_questions(questions, routing.vocabulary(metadata, chunks)), "routed")
    vectors, _ = enrichment.embedded_documents(enrichment.embed_chunks(chunks, models.HashingEmbedder()))
    fingerprints = nation.select("doc_id", F.sha1("doc_id").alias("sha1"))
    answers = answering.answer_questions(
        routed, chunks, chunks.select("doc_id", "page", "text"), vectors, fingerprints,
        answering.Models(answerer=AccountAnswerer(), embedder=PickyEmbedder()),
    )
    amount = F.when(F.size("doc_ids") < 2, F.col("final_answer").try_cast("double"))
    return answers.select(
        "question_id", routing.dispatch(F.col("doc_ids")).alias("route_kind"), amount.alias("amount"),
        F.when(amount.isNotNull(), "").otherwise(F.col("final_answer")).alias("answer"),
        F.get("relevant_pages", F.lit(0)).alias("first_page"),
        F.when(F.col("error").isNull(), F.size("doc_ids")).otherwise(0).alias("n_reports"), "error",
    )
