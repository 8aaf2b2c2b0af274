"""Registered queries: lexical and dense search, fusion, rerank, routing, parent context."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import elements as E
from folioquery.operators import fusion, lexical, parents, rerank, routing, vectors
from folioquery.plans import derived as D
from folioquery.plans import sqltext as S
from folioquery.plans.registry import query
from folioquery.plans.structure import document_chunks
from folioquery.sources.tables import table


EVERYTHING = "all"  # the one route of the searches: a question meets every document and every vector


# ---- lexical ---------------------------------------------------------------------

LEXICAL_STATS = f"""
toks AS (SELECT doc_id, source, {S.lexical('text')} AS t FROM documents),
tf AS (
  SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(t) AS term FROM toks)
  GROUP BY 1, 2, 3
),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY 1, 2),
size AS (SELECT source, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
idf AS (SELECT source, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN size USING (source))"""

CORPUS_STATS = f"""
toks AS (SELECT doc_id, source, {S.lexical('text')} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
idf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, size)"""

BM25_HITS = CORPUS_STATS + f""",
used AS (
  SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf
),
asked AS (SELECT item_id AS question_id, unnest({S.lexical('text')}) AS term FROM benchmark),
partial AS (
  SELECT a.question_id, tf.doc_id,
    sum(u.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(k.t) / s.avgdl))) AS score
  FROM asked a JOIN tf USING (term) JOIN used u USING (term) JOIN toks k ON k.doc_id = tf.doc_id, size s
  GROUP BY 1, 2
),
bm25_all AS (
  SELECT b.item_id AS question_id, d.doc_id AS chunk_id, round(coalesce(p.score, 0), 6) AS score
  FROM benchmark b CROSS JOIN documents d
  LEFT JOIN partial p ON p.question_id = b.item_id AND p.doc_id = d.doc_id
),
bm25 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)
    AS rank FROM bm25_all) WHERE rank <= 30
)"""

COSINE_HITS = """
cosine_all AS (
  SELECT q.vec_id AS question_id, c.vec_id AS chunk_id,
    round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings c
),
cosine AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)
    AS rank FROM cosine_all) WHERE rank <= 30
)"""

HYBRID = BM25_HITS + "," + COSINE_HITS + """,
scaled AS (
  SELECT question_id, chunk_id, CASE WHEN hi - lo <= 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s,
    side FROM (
    SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (
      SELECT question_id, chunk_id, score, 'b' AS side FROM bm25
      UNION ALL SELECT question_id, chunk_id, score, 'v' FROM cosine)
    WINDOW w AS (PARTITION BY question_id, side))
),
fused AS (
  SELECT question_id, chunk_id, coalesce(max(s) FILTER (side = 'v'), 0) AS v,
    coalesce(max(s) FILTER (side = 'b'), 0) AS b FROM scaled GROUP BY 1, 2
),
hybrid AS (
  SELECT question_id, chunk_id, rank, round(v, 4) AS score_vec, round(b, 4) AS score_bm25,
    round(f, 4) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(f, 6) DESC, chunk_id) AS rank
    FROM (SELECT *, 0.6 * v + (1 - 0.6) * b AS f FROM fused))
  WHERE rank <= 20
)"""


def lexical_corpus(spark, folder, route):
    return table(spark, folder, "documents").select(
        route.alias("route"), F.col("doc_id").alias("chunk_id"), "text"
    )


def asked_questions(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.lit(EVERYTHING).alias("route"), F.col("item_id").alias("question_id"), "text"
    )


@query("bm25_term_stats", f"""
WITH {LEXICAL_STATS} SELECT source, term, df, round(idf, 6) AS idf FROM idf""")
def bm25_term_stats(spark, folder):
    stats = lexical.term_stats(lexical.build_index(lexical_corpus(spark, folder, F.col("source"))))
    return stats.select(F.col("route").alias("source"), "term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_source_stats", f"""
WITH toks AS (SELECT doc_id, source, {S.lexical('text')} AS t FROM documents),
df AS (SELECT source, term, count(*) AS df FROM (
  SELECT DISTINCT source, doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
size AS (SELECT source, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY 1)
SELECT source, n AS n_chunks, round(any_value(avgdl), 6) AS avgdl, count(*) AS n_terms,
  round(avg(ln(n - df + 0.5) - ln(df + 0.5)), 6) AS mean_idf
FROM df JOIN size USING (source) GROUP BY source, n""")
def bm25_source_stats(spark, folder):
    """Index statistics with every source as one indexed report."""
    stats = lexical.corpus_stats(lexical.build_index(lexical_corpus(spark, folder, F.col("source"))))
    return stats.select(
        F.col("route").alias("source"), "n_chunks", F.round("avgdl", 6).alias("avgdl"), "n_terms",
        F.round("mean_idf", 6).alias("mean_idf"),
    )


def bm25_hits(spark, folder):
    index = lexical.build_index(lexical_corpus(spark, folder, F.lit(EVERYTHING)))
    return lexical.bm25_topk(index, asked_questions(spark, folder))


@query("bm25_topk", f"""
WITH {BM25_HITS} SELECT question_id, chunk_id, rank, score FROM bm25""")
def bm25_topk(spark, folder):
    return bm25_hits(spark, folder).select(
        "question_id", "chunk_id", "rank", F.round("score", 6).alias("score")
    )


def cosine_hits(spark, folder):
    vectors_ = table(spark, folder, "embeddings").select(
        F.lit(EVERYTHING).alias("route"), F.col("vec_id").alias("chunk_id"), "embedding"
    )
    question_vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("question_id"), "embedding"
    )
    asked = asked_questions(spark, folder).select("route", "question_id").join(
        question_vectors, "question_id"
    )
    return vectors.cosine_topk(vectors_, asked)


@query("cosine_topk", f"""
WITH {COSINE_HITS} SELECT question_id, chunk_id, rank, score FROM cosine""")
def cosine_topk(spark, folder):
    return cosine_hits(spark, folder).select(
        "question_id", "chunk_id", "rank", F.round("score", 6).alias("score")
    )


@query("unit_vectors", """
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS squared_length,
  round(e[1], 4) AS first_value FROM (
  SELECT vec_id, list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE) AS e
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 2)) AS v FROM embeddings))""")
def unit_vectors(spark, folder):
    """Normalization undoes a scaling of each vector."""
    scaled = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 2)).alias("v"),
    )
    unit = scaled.select(
        "vec_id",
        F.transform(vectors.l2_normalize(F.col("v")), lambda x: x.cast("float").cast("double"))
        .alias("e"),
    )
    return unit.select(
        "vec_id",
        F.round(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x * x), 4).alias("squared_length"),
        F.round(F.get("e", F.lit(0)), 4).alias("first_value"),
    )


def hybrid_hits(spark, folder):
    return fusion.fuse_hits(cosine_hits(spark, folder), bm25_hits(spark, folder))


@query("hybrid_fusion_topk", f"""
WITH {HYBRID} SELECT question_id, chunk_id, rank, score_vec, score_bm25, score FROM hybrid""")
def hybrid_fusion_topk(spark, folder):
    return hybrid_hits(spark, folder).drop("route")


@query("rerank_combine", f"""
WITH {HYBRID},
rated AS (
  SELECT h.*, ((h.rank - 1) // 10)::INT AS batch_no,
    CASE WHEN l.quality IS NULL THEN 0.3 WHEN l.quality = 1 THEN 0.9 ELSE 0.5 END::DECIMAL(4, 3) AS rel
  FROM hybrid h LEFT JOIN labels l ON l.doc_id = h.chunk_id
),
mixed AS (
  SELECT *, round(0.7::DECIMAL(2, 1) * rel + 0.3::DECIMAL(2, 1) * score::DECIMAL(7, 4), 4)::DOUBLE
    AS combined_score FROM rated
)
SELECT question_id, chunk_id, batch_no, rel::DOUBLE AS relevance_score, combined_score, rerank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY combined_score DESC, rank) AS rerank
  FROM mixed) WHERE rerank <= 6""")
def rerank_combine(spark, folder):
    """Labels stand in for the relevance a model would give."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    relevance = F.when(F.col("quality").isNull(), 0.3).when(F.col("quality") == 1, 0.9).otherwise(0.5)
    scored = rerank.with_batches(hybrid_hits(spark, folder)).join(labels, "chunk_id", "left")
    ranked = rerank.combine_rankings(
        scored.withColumn("relevance_score", relevance), ["question_id"]
    )
    return ranked.select(
        "question_id", "chunk_id", "batch_no", "relevance_score", "combined_score", "rerank"
    )


# ---- embedding batches --------------------------------------------------------------

@query("embedding_batches", f"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, {S.tokens('text')} AS t FROM conversations
),
walk AS (
  SELECT conv_id, turn, 1 AS n, t AS tok, turn AS batch_start FROM rows_ WHERE turn = 0
  UNION ALL
  SELECT r.conv_id, r.turn,
    CASE WHEN w.n >= 4 OR w.tok + r.t > 200 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 4 OR w.tok + r.t > 200 THEN r.t ELSE w.tok + r.t END,
    CASE WHEN w.n >= 4 OR w.tok + r.t > 200 THEN r.turn ELSE w.batch_start END
  FROM walk w JOIN rows_ r ON r.conv_id = w.conv_id AND r.turn = w.turn + 1
)
SELECT conv_id, turn, tok_ AS n_tokens, batch_start
FROM (SELECT w.conv_id, w.turn, r.t AS tok_, w.batch_start FROM walk w JOIN rows_ r USING (conv_id, turn))""")
def embedding_batches(spark, folder):
    """Turns of a conversation as chunks; four rows or 200 tokens to a request."""
    from folioquery.functions.text import token_count

    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", token_count(F.col("text")).alias("n_tokens")
    )
    return vectors.embedding_batches(
        rows, "conv_id", "turn", "n_tokens", batch_size=4, budget=200
    )


# ---- routing ---------------------------------------------------------------------------

@query("route_entities", """
SELECT o_orderkey AS question_id,
  CASE WHEN length(c_name) >= length(n_name) THEN 'cust.' || c_custkey || '|' || lower(n_name)
       ELSE lower(n_name) || '|cust.' || c_custkey END AS doc_ids,
  'comparative' AS route_kind
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def route_entities(spark, folder):
    """A question per order that names its customer and its nation."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    metadata = customer.select(
        F.col("c_name").alias("company"),
        F.concat(F.lit("raw/cust."), "c_custkey", F.lit(".pdf")).alias("filename"),
        F.col("c_custkey").alias("csv_ord"),
    ).unionByName(nation.select(
        F.col("n_name").alias("company"),
        F.concat(F.lit("raw/"), F.lower("n_name"), F.lit(".pdf")).alias("filename"),
        (-1 - F.col("n_nationkey")).cast("long").alias("csv_ord"),
    ))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "n_name"
    )
    questions = table(spark, folder, "orders").join(places, "o_custkey").select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(
            F.lit("Did "), F.upper("c_name"), F.lit(", based in "), "n_name",
            F.lit(", place an order of "), F.col("o_totalprice").cast("string"), F.lit("?"),
        ).alias("question"),
    )
    routed = routing.route_questions(questions, routing.vocabulary(metadata))
    return routed.select(
        "question_id", F.array_join("doc_ids", "|").alias("doc_ids"),
        routing.dispatch(F.col("doc_ids")).alias("route_kind"),
    )


@query("route_overlaps", """
WITH asked AS (
  SELECT o_orderkey AS question_id, left(o_orderpriority, 1)::INT AS kind, 'cust.' || c_custkey AS cust, c_name,
    lower(n_name) AS nation, n_name || ' ' || r_name AS place, lower(r_name) || '-region' AS region
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
)
SELECT question_id,
  CASE kind WHEN 1 THEN CASE WHEN length(c_name) > length(place) THEN cust || '|' || nation ELSE nation || '|' || cust END
    WHEN 2 THEN cust WHEN 3 THEN region WHEN 4 THEN '' ELSE nation END AS doc_ids,
  CASE kind WHEN 1 THEN 'comparative' WHEN 4 THEN 'unanswerable' ELSE 'single' END AS route_kind FROM asked""")
def route_overlaps(spark, folder):
    """Orders asked about by customer and place, by one of them, or by neither; regions are part of longer names.

    A nation's report is known by nation and region together, so its name in a question
    consumes the region, which is the name of another report.
    """
    region = table(spark, folder, "region")
    place = table(spark, folder, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "n_nationkey", "n_name", "r_name", F.concat_ws(" ", "n_name", "r_name").alias("place")
    )
    customer = table(spark, folder, "customer")
    metadata = customer.select(
        F.col("c_name").alias("company"), F.concat(F.lit("raw/cust."), "c_custkey", F.lit(".pdf")).alias("filename"),
        F.col("c_custkey").alias("csv_ord"),
    ).unionByName(place.select(
        F.col("place").alias("company"), F.concat(F.lit("raw/"), F.lower("n_name"), F.lit(".pdf")).alias("filename"),
        (-1 - F.col("n_nationkey")).cast("long").alias("csv_ord"),
    )).unionByName(region.select(
        F.col("r_name").alias("company"), F.concat(F.lit("raw/"), F.lower("r_name"), F.lit("-region.pdf")).alias("filename"),
        (-100 - F.col("r_regionkey")).cast("long").alias("csv_ord"),
    ))
    kind = F.substring("o_orderpriority", 1, 1)
    named = (
        F.when(kind == "1", F.concat(F.lower("c_name"), F.lit(" of "), "place")).when(kind == "2", F.col("c_name"))
        .when(kind == "3", F.concat(F.lit("somebody in "), F.initcap("r_name"))).when(kind == "4", F.lit("nobody in EUROPEAN ASIATIC parts"))
        .otherwise(F.concat(F.lit("somebody in "), "n_name"))
    )
    questions = (
        table(spark, folder, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(place, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("What did "), named, F.lit(", on that day, order?")).alias("question"))
    )
    routed = routing.route_questions(questions, routing.vocabulary(metadata))
    return routed.select(
        "question_id", F.array_join("doc_ids", "|").alias("doc_ids"), routing.dispatch(F.col("doc_ids")).alias("route_kind")
    )


# ---- parent context ------------------------------------------------------------------------

HEADING_CANDIDATES = S.ELEMENTS + """,
cands AS (
  SELECT doc_id, idx AS els_start, idx + 1 AS els_end, page,
    row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, idx) AS rank
  FROM elements WHERE type = 'heading'
)"""

PARTS = f""",
parts AS (
  SELECT n.doc_id, n.idx,
    CASE WHEN n.type = 'table' THEN coalesce(array_to_string(list_filter(string_split(
             regexp_replace(n.html, '</?t[a-z]+>', '', 'g'), '. '), lambda x: length(x) > 0), {S.NL}),
             nullif(n.text, ''), '[table]')
         WHEN n.type = 'picture' AND e.text <> '' THEN 'Reading of ' || e.text
         WHEN n.type = 'heading' AND n.text <> '' THEN repeat('#', least(n.level, 4)) || ' ' || n.text
         ELSE nullif(n.text, '') END AS part
  FROM normal n JOIN elements e USING (doc_id, idx)
)"""

SPANS = HEADING_CANDIDATES + """,
wide AS (
  SELECT doc_id, w AS win, greatest(0, els_start - w) AS s, els_end + w AS e
  FROM cands, (SELECT unnest([15, 7, 3, 1, 0]) AS w)
),
marked AS (
  SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id, win ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM wide
),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, win ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked
),
spans AS (
  SELECT doc_id, win, min(s) AS span_start, max(e) AS span_end FROM islands GROUP BY doc_id, win, g
)"""


def heading_candidates(elements):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "idx")
    return elements.where(F.col("type") == "heading").select(
        "doc_id", F.col("idx").alias("els_start"), (F.col("idx") + 1).alias("els_end"), "page",
        F.row_number().over(order).alias("rank"),
    )


@query("parent_pages", f"""
WITH {HEADING_CANDIDATES},
texts AS (
  SELECT doc_id, seq // {D.LINES_PER_PAGE} + 1 AS page, string_agg(line, {S.NL} ORDER BY seq) AS text
  FROM lines GROUP BY 1, 2
),
firsts AS (SELECT doc_id, page, min(rank) AS f FROM cands GROUP BY 1, 2)
SELECT f.doc_id, f.page, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.f) AS page_rank, t.text
FROM firsts f JOIN texts t USING (doc_id, page)""")
def parent_pages(spark, folder):
    """Headings, longest first, as the ranked candidates of each report."""
    elements = D.report_elements(spark, folder)
    lines = F.split("text", "\n")
    n = D.LINES_PER_PAGE
    pages = table(spark, folder, "documents").select("doc_id", lines.alias("l")).select(
        "doc_id",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("l") / n).cast("int") - 1),
            lambda i: F.array_join(F.slice("l", i * n + 1, n), "\n"),
        )).alias("page", "text"),
    ).withColumn("page", F.col("page") + 1)
    return parents.parent_pages(heading_candidates(elements), pages, [])


@query("parent_spans", f"""
WITH {SPANS} SELECT doc_id, win AS "window", span_start, span_end FROM spans""")
def parent_spans(spark, folder):
    cands = heading_candidates(D.report_elements(spark, folder))
    return parents.merged_spans(cands, [], parents.halving(parents.WINDOW))


@query("span_budget", f"""
WITH {SPANS}{PARTS},
texts AS (
  SELECT s.doc_id, s.win, s.span_start, s.span_end,
    coalesce(string_agg(p.part, {S.NL}||{S.NL} ORDER BY p.idx), '') AS text
  FROM spans s LEFT JOIN parts p ON p.doc_id = s.doc_id AND p.part IS NOT NULL
    AND p.idx >= s.span_start AND p.idx < s.span_end
  GROUP BY ALL
),
pick AS (
  SELECT doc_id, coalesce(max(win) FILTER (total <= 1500), 0) AS win
  FROM (SELECT doc_id, win, sum(length(text)) AS total FROM texts GROUP BY 1, 2) GROUP BY doc_id
)
SELECT doc_id, win AS "window", span_start, span_end, text FROM texts JOIN pick USING (doc_id, win)""")
def span_budget(spark, folder):
    """Widened spans around the headings, halved until a report's text fits 1500 characters."""
    elements = D.with_readings(D.report_elements(spark, folder))
    tables = D.serialized_tables(elements)
    return parents.parent_context(
        heading_candidates(elements), [], "els_window", elements=elements, tables=tables,
        max_chars=1500,
    )


@query("context_fuse", """
SELECT source, doc_id FROM (
  SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS total
  FROM documents) WHERE total <= 60000""")
def context_fuse(spark, folder):
    """Documents of a source in order until their text reaches the context limit."""
    docs = table(spark, folder, "documents")
    return parents.keep_prefix(docs, ["source"], "doc_id", F.length("text")).select(
        "source", "doc_id"
    )


@query("context_cap_keep_first", """
SELECT source, doc_id FROM (
  SELECT source, doc_id, sum(length(text)) OVER w AS total, row_number() OVER w AS nth
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
WHERE total <= 300 OR nth = 1""")
def context_cap_keep_first(spark, folder):
    docs = table(spark, folder, "documents")
    return parents.keep_prefix(
        docs, ["source"], "doc_id", F.length("text"), cap=300, keep_first=True
    ).select("source", "doc_id")


@query("page_validation", """
WITH rows_ AS (
  SELECT l_orderkey, l_partkey % 40 AS c, l_suppkey % 40 AS g,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 40, l_suppkey % 40) AS nth
  FROM lineitem
),
per AS (SELECT l_orderkey, list(c ORDER BY nth) AS cited FROM rows_ GROUP BY 1),
given AS (
  SELECT l_orderkey, list(page ORDER BY f) AS provided FROM (
    SELECT l_orderkey, g AS page, min(nth) AS f FROM rows_ GROUP BY 1, 2) GROUP BY 1
),
firsts AS (
  SELECT l_orderkey, page, min(pos) AS pos FROM (
    SELECT l_orderkey, unnest(cited) AS page, generate_subscripts(cited, 1) AS pos FROM per) GROUP BY 1, 2
),
kept AS (
  SELECT f.l_orderkey, list(f.page ORDER BY f.pos) AS kept FROM firsts f JOIN given g USING (l_orderkey)
  WHERE list_contains(g.provided, f.page) GROUP BY 1
),
both_ AS (
  SELECT g.l_orderkey, coalesce(k.kept, []) AS kept,
    list_filter(g.provided, lambda x: NOT list_contains(coalesce(k.kept, []), x)) AS rest
  FROM given g LEFT JOIN kept k USING (l_orderkey)
)
SELECT l_orderkey, array_to_string(list_concat(kept, rest[1:greatest(0, 2 - len(kept))])[1:8], ',') AS pages
FROM both_""")
def page_validation(spark, folder):
    """Pages cited by the lines of an order, checked against the pages it was given."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("cited"),
        (F.col("l_suppkey") % 40).alias("given"),
    )
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "cited", "given")))
    per = lines.groupBy("l_orderkey").agg(pairs.alias("p"))
    pages = parents.valid_pages(
        F.transform("p", lambda x: x["cited"]),
        F.array_distinct(F.transform("p", lambda x: x["given"])),
    )
    return per.select("l_orderkey", F.array_join(pages, ",").alias("pages"))
