"""Registered queries: contexts, answer scoring, recall, resume and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions import answers as A
from folioquery.functions import text as X
from folioquery.operators import context, evaluation
from folioquery.plans import derived as D
from folioquery.plans import sqltext as S
from folioquery.plans.registry import query
from folioquery.sources import stages
from folioquery.sources.tables import table

# ---- contexts -------------------------------------------------------------------


@query("table_context", f"""
WITH {S.ELEMENTS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS pos FROM elements
),
tabs AS (
  SELECT t.doc_id, t.table_id, t.page, t.pos,
    coalesce(max(o.pos) FILTER (o.pos < t.pos), 0) AS prev,
    min(o.pos) FILTER (o.pos > t.pos) AS nxt
  FROM placed t JOIN placed o ON o.doc_id = t.doc_id AND o.page = t.page AND o.type = 'table'
  WHERE t.type = 'table' GROUP BY 1, 2, 3, 4
)
SELECT t.doc_id, t.table_id, t.page,
  coalesce(string_agg(b.text, {S.NL} ORDER BY b.pos)
    FILTER (b.text <> '' AND b.pos > t.prev AND b.pos < t.pos), '') AS before,
  coalesce(string_agg(b.text, {S.NL} ORDER BY b.pos)
    FILTER (b.text <> '' AND b.pos > t.pos AND b.pos < coalesce(t.nxt - 1, t.pos + 4)), '') AS after
FROM tabs t JOIN placed b ON b.doc_id = t.doc_id AND b.page = t.page GROUP BY 1, 2, 3, t.pos""")
def table_context(spark, folder):
    return context.table_context(D.report_elements(spark, folder))


@query("picture_context", f"""
WITH {S.ELEMENTS},
near AS (
  SELECT p.doc_id, p.idx, n.idx AS oidx, n.text,
    row_number() OVER (PARTITION BY p.doc_id, p.idx, n.idx < p.idx
      ORDER BY abs(n.idx - p.idx)) AS nth
  FROM elements p LEFT JOIN normal n ON n.doc_id = p.doc_id AND n.page = p.page
    AND n.type <> 'picture' AND n.text <> '' WHERE p.type = 'picture'
)
SELECT doc_id, idx,
  coalesce(string_agg(text, {S.NL} ORDER BY oidx) FILTER (nth <= 3 AND oidx < idx), '') AS before,
  coalesce(string_agg(text, {S.NL} ORDER BY oidx) FILTER (nth <= 3 AND oidx > idx), '') AS after
FROM near GROUP BY 1, 2""")
def picture_context(spark, folder):
    return context.picture_context(D.report_elements(spark, folder))


@query("adjacent_context", """
SELECT conv_id, turn,
  coalesce(last_value(CASE WHEN role = 'user' THEN right(text, 800) END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '(none)')
    AS previous,
  coalesce(first_value(CASE WHEN role = 'user' THEN left(text, 800) END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '(none)')
    AS following
FROM conversations""")
def adjacent_context(spark, folder):
    """User turns play the prose chunks, other turns the tables between them."""
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text",
        F.when(F.col("role") == "user", "content").otherwise("serialized_table").alias("type"),
    )
    return context.adjacent_prose(turns, "conv_id", "turn").select(
        "conv_id", "turn", "previous", "following"
    )


@query("numeric_conservation", f"""
WITH pairs AS (
  SELECT doc_id, text, regexp_replace(text, '[0-9]\\s', '', 'g') AS rewritten FROM documents
),
found AS (
  SELECT doc_id, rewritten, {S.numbers('rewritten')} AS kept, unnest({S.numbers('text')}) AS tok,
    generate_subscripts({S.numbers('text')}, 1) AS pos FROM pairs
),
missing AS (
  SELECT doc_id, tok, min(pos) AS pos FROM found WHERE NOT list_contains(kept, tok) GROUP BY 1, 2
),
reasons AS (SELECT doc_id, string_agg(tok, ', ' ORDER BY pos) AS toks FROM missing GROUP BY 1)
SELECT doc_id, CASE WHEN {S.strip('rewritten')} = '' THEN 'empty_transformed_text'
  WHEN toks IS NOT NULL THEN 'numeric_tokens_missing: ' || toks END AS reason
FROM pairs LEFT JOIN reasons USING (doc_id)""")
def numeric_conservation(spark, folder):
    """A rewrite that drops some final digits must be refused with the lost numbers."""
    rewritten = F.regexp_replace("text", r"[0-9]\s", "")
    return table(spark, folder, "documents").select(
        "doc_id", X.numeric_conservation(F.col("text"), rewritten).alias("reason")
    )


# ---- answers --------------------------------------------------------------------------

GOLD_AND_ANSWERS = """
money AS (SELECT *, o_totalprice::DECIMAL(15, 2) AS price FROM orders),
answered AS (
  SELECT o_orderkey AS question,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'number' WHEN '2-HIGH' THEN 'boolean'
      WHEN '3-MEDIUM' THEN 'name' WHEN '4-NOT SPECIFIED' THEN 'names' ELSE 'text' END AS kind,
    CASE WHEN o_custkey % 11 = 0 THEN 'N/A'
      WHEN o_orderpriority = '1-URGENT' THEN '(' || price::VARCHAR || '%)'
      WHEN o_orderpriority = '2-HIGH' THEN ['Yes', 'no ', 'TRUE', 'perhaps', '0'][o_custkey % 5 + 1]
      WHEN o_orderpriority = '3-MEDIUM' THEN 'Clerk, of ' || o_orderstatus || ' (Inc.)'
      ELSE o_orderstatus || '.' END AS pred,
    CASE WHEN o_custkey % 7 = 0 THEN ' n/a'
      WHEN o_orderpriority = '1-URGENT' THEN (-price * (1 + 0.005 * (o_custkey % 5)))::DECIMAL(15, 2)::VARCHAR
      WHEN o_orderpriority = '2-HIGH' THEN ['true', 'False', 'perhaps'][o_custkey % 3 + 1]
      WHEN o_orderpriority = '3-MEDIUM' THEN ['clerk of ' || lower(o_orderstatus), 'CLERK  of', 'agent'][o_custkey % 3 + 1]
      ELSE lower(o_orderstatus) || ' ' END AS gold
  FROM money
)"""


def _norm(x: str) -> str:
    from folioquery.functions.text import WHITESPACE_CLASS as W

    return (
        f"regexp_replace(regexp_replace(lower({S.strip(x)}), '[^\\p{{L}}\\p{{N}}_{W}]', ' ', 'g'), "
        f"'[{W}]+', ' ', 'g')"
    )


def _number(x: str) -> str:
    bare = f"trim(rtrim(trim(replace(trim({x}), ',', ''), '()'), '%'))"
    sign = f"CASE WHEN trim({x}) LIKE '(%' AND trim({x}) LIKE '%)' THEN -1 ELSE 1 END"
    return f"({sign} * TRY_CAST({bare} AS DOUBLE))"


SCORED = GOLD_AND_ANSWERS + f""",
normed AS (
  SELECT *, {_norm('pred')} AS p, {_norm('gold')} AS g, {_number('pred')} AS a, {_number('gold')} AS b,
    CASE WHEN lower(trim(pred)) IN ('true', 'yes', '1') THEN true
         WHEN lower(trim(pred)) IN ('false', 'no', '0') THEN false END AS pb,
    CASE WHEN lower(trim(gold)) IN ('true', 'yes', '1') THEN true
         WHEN lower(trim(gold)) IN ('false', 'no', '0') THEN false END AS gb
  FROM answered
),
flags AS (
  SELECT *, p IN ('n a', 'na', 'none', 'not available', '') AS pna,
    g IN ('n a', 'na', 'none', 'not available', '') AS gna FROM normed
),
scored AS (
  SELECT question, kind, pred AS final_answer, gna AS na,
    CASE kind
      WHEN 'number' THEN CASE WHEN pna OR gna THEN pna AND gna ELSE
        coalesce(abs(a - b) <= 0.01 * greatest(abs(a), abs(b), 1e-9), false) END
      WHEN 'boolean' THEN CASE WHEN pb IS NULL OR gb IS NULL THEN p = g ELSE pb = gb END
      WHEN 'name' THEN p <> '' AND g <> '' AND (contains(p, g) OR contains(g, p))
      ELSE p = g END AS ok
  FROM flags
)"""


def scored_orders(spark, folder):
    price = F.col("o_totalprice").cast("decimal(15,2)")
    c = F.col("o_custkey")

    def pick(values, n):
        return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), c % n)

    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "number").when(priority == "2-HIGH", "boolean")
        .when(priority == "3-MEDIUM", "name").when(priority == "4-NOT SPECIFIED", "names")
        .otherwise("text")
    )
    status = F.col("o_orderstatus")
    rate = F.lit(1) + F.lit("0.005").cast("decimal(4,3)") * (c % 5).cast("decimal(1,0)")
    pred = (
        F.when(c % 11 == 0, "N/A")
        .when(kind == "number", F.concat(F.lit("("), price.cast("string"), F.lit("%)")))
        .when(kind == "boolean", pick(["Yes", "no ", "TRUE", "perhaps", "0"], 5))
        .when(kind == "name", F.concat(F.lit("Clerk, of "), status, F.lit(" (Inc.)")))
        .otherwise(F.concat(status, F.lit(".")))
    )
    gold = (
        F.when(c % 7 == 0, " n/a")
        .when(kind == "number", (-price * rate).cast("decimal(15,2)").cast("string"))
        .when(kind == "boolean", pick(["true", "False", "perhaps"], 3))
        .when(kind == "name", pick(
            [F.concat(F.lit("clerk of "), F.lower(status)), "CLERK  of", "agent"], 3))
        .otherwise(F.concat(F.lower(status), F.lit(" ")))
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("question"), kind.alias("kind"), pred.alias("final_answer"),
        gold.alias("gold"),
    )
    predictions = orders.select("question", "final_answer", F.array("final_answer").alias("items"))
    golds = orders.select("question", "kind", A.golds_of(F.array("gold")).alias("golds"))
    return evaluation.score_run(predictions, golds)


@query("answer_scoring", f"""
WITH {SCORED} SELECT question, kind, final_answer, ok, na FROM scored""")
def answer_scoring(spark, folder):
    return scored_orders(spark, folder).drop("golds")


@query("accuracy_slices", f"""
WITH {SCORED}
SELECT slice, count(*) FILTER (ok) AS n_ok, count(*) AS n,
  round((count(*) FILTER (ok)) / count(*)::DOUBLE, 6) AS accuracy
FROM (SELECT ok, unnest(['overall', 'kind:' || kind, CASE WHEN na THEN 'na' ELSE 'answerable' END]) AS slice
      FROM scored) GROUP BY slice""")
def accuracy_slices(spark, folder):
    return evaluation.accuracy_slices(scored_orders(spark, folder))


@query("wrong_answers", f"""
WITH {SCORED}
SELECT question, kind, final_answer FROM scored WHERE NOT ok ORDER BY question LIMIT 10""")
def wrong_answers(spark, folder):
    """The report of the first ten wrong answers."""
    return evaluation.wrong_answers(scored_orders(spark, folder)).select(
        "question", "kind", "final_answer"
    )


@query("guess_kind", f"""
SELECT conv_id, turn, CASE
  WHEN regexp_matches(q, '^(did|does|is|was|were|has|have) ') THEN 'boolean'
  WHEN regexp_matches(q, 'how many|what was the value|what is the value|\\(%\\)|in usd|amount') THEN 'number'
  WHEN regexp_matches(q, 'who were|names of|list of|members of') THEN 'names' ELSE 'name' END AS kind
FROM (SELECT conv_id, turn, lower({S.strip('text')}) AS q FROM conversations)""")
def guess_kind(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", A.guess_kind(F.col("text")).alias("kind")
    )


# ---- recall ---------------------------------------------------------------------------

RECALL = """
lines_ AS (
  SELECT o_custkey AS question_id, l_suppkey % 4 AS doc_id, l_partkey % 12 AS page,
    row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
),
pools AS (
  SELECT o_custkey AS question_id, o_orderkey AS pool_no, unnest([o_orderkey % 5, o_custkey % 3]) AS doc_id,
    unnest([o_orderkey % 12, o_orderkey % 9]) AS page FROM orders
),
good AS (
  SELECT question_id, pool_no FROM pools GROUP BY 1, 2 HAVING bool_and(doc_id IN (SELECT DISTINCT doc_id FROM lines_))
),
want AS (SELECT DISTINCT p.* FROM pools p JOIN good USING (question_id, pool_no)),
order_of AS (
  SELECT question_id, doc_id, page, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY f) AS page_rank
  FROM (SELECT question_id, doc_id, page, min(rank) AS f FROM lines_ GROUP BY 1, 2, 3)
),
per_pool AS (
  SELECT w.question_id, w.pool_no, k, count(*) FILTER (o.page_rank <= k) / count(*)::DOUBLE AS r
  FROM want w LEFT JOIN order_of o USING (question_id, doc_id, page), (SELECT unnest([5, 10, 20]) AS k)
  GROUP BY 1, 2, 3
),
recall AS (SELECT question_id, k, avg(r) AS recall FROM per_pool GROUP BY 1, 2)"""


def recall_inputs(spark, folder, longest_first=False):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    by = [F.col(c) for c in ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    if longest_first:
        by = [-F.col("l_quantity"), *by]
    cands = lines.join(orders, "o_orderkey").select(
        F.col("o_custkey").alias("question_id"), (F.col("l_suppkey") % 4).alias("doc_id"),
        (F.col("l_partkey") % 12).alias("page"), F.struct(*by).alias("rank"),
    )
    refs = F.array(
        F.concat("d1", F.lit(":"), F.col("o_orderkey") % 12),
        F.concat("d2", F.lit(":"), F.col("o_orderkey") % 9),
    )
    named = orders.withColumn("d1", (F.col("o_orderkey") % 5).cast("string")).withColumn(
        "d2", (F.col("o_custkey") % 3).cast("string")
    )
    doc, page = evaluation.split_reference(F.col("ref"))
    pools = named.select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pool_no"),
        F.explode(refs).alias("ref"),
    ).select("question_id", "pool_no", doc.cast("long").alias("doc_id"), page.alias("page"))
    return cands, evaluation.usable_pools(pools, cands)


@query("recall_at_k", f"""
WITH {RECALL} SELECT question_id, k, round(recall, 6) AS recall FROM recall""")
def recall_at_k(spark, folder):
    """Line items of a customer as candidates, its orders as reference pools."""
    cands, pools = recall_inputs(spark, folder)
    return evaluation.recall_at(cands, pools).select(
        "question_id", "k", F.round("recall", 6).alias("recall")
    )


assert "lines_ AS" in RECALL and "ORDER BY l_orderkey," in RECALL and "LEFT JOIN order_of o" in RECALL
_ARM_B = RECALL.replace("lines_ AS", "lines_b AS", 1).replace(
    "ORDER BY l_orderkey,", "ORDER BY l_quantity DESC, l_orderkey,"
)
for _name in ("order_of", "per_pool", "recall"):
    _ARM_B = _ARM_B.replace(f"{_name} AS", f"{_name}_b AS").replace(f"FROM {_name} ", f"FROM {_name}_b ")
_ARM_B = _ARM_B.replace("LEFT JOIN order_of o", "LEFT JOIN order_of_b o").replace(
    "min(rank) AS f FROM lines_ ", "min(rank) AS f FROM lines_b ")
_ARM_B = _ARM_B[:_ARM_B.index("pools AS")] + _ARM_B[_ARM_B.index("order_of_b AS"):]


@query("recall_ablation", f"""
WITH {RECALL},{_ARM_B}
SELECT a.k, count(*) AS n, round(avg(a.recall), 6) AS recall_a, round(avg(b.recall), 6) AS recall_b,
  round((avg(a.recall) - avg(b.recall)) * 100, 4) AS delta_points
FROM recall a JOIN recall_b b USING (question_id, k) GROUP BY a.k""")
def recall_ablation(spark, folder):
    """The same pools against two candidate orders."""
    cands_a, pools = recall_inputs(spark, folder)
    cands_b, _ = recall_inputs(spark, folder, longest_first=True)
    return evaluation.recall_ablation(
        evaluation.recall_at(cands_a, pools), evaluation.recall_at(cands_b, pools)
    )


@query("common_pools", """
WITH pools AS (
  SELECT o_custkey AS question_id, o_orderkey AS pool_no, unnest([o_orderkey % 5, o_custkey % 6]) AS doc_id FROM orders
),
a AS (SELECT DISTINCT l_suppkey % 4 AS doc_id FROM lineitem),
b AS (SELECT DISTINCT l_suppkey % 4 + 1 AS doc_id FROM lineitem)
SELECT question_id, pool_no, count(DISTINCT doc_id) AS n_documents FROM pools GROUP BY 1, 2
HAVING bool_and(doc_id IN (SELECT doc_id FROM a) AND doc_id IN (SELECT doc_id FROM b))""")
def common_pools(spark, folder):
    """Pools of the orders against two indexes that share some documents only."""
    orders = table(spark, folder, "orders")
    pools = orders.select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pool_no"),
        F.explode(F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 6)).alias("doc_id"), F.lit(1).alias("page"),
    ).distinct()
    lines = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 4).alias("doc_id"))
    both = evaluation.common_pools(pools, lines, lines.select((F.col("doc_id") + 1).alias("doc_id")))
    return both.groupBy("question_id", "pool_no").agg(F.count("*").alias("n_documents"))


@query("gold_spellings", """
SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN c_name || '|x'
    WHEN 3 THEN c_name || '|None|5' ELSE '[' || chr(39) || c_name || chr(39) || ', ' || chr(39) || 'y' || chr(39) || ']' END AS golds,
  CASE c_custkey % 5 WHEN 4 THEN 2 ELSE 1 END AS n_items
FROM customer""")
def gold_spellings(spark, folder):
    """Gold answers in every spelling that occurs: quotes of all kinds, JSON words, nested lists, plain text."""
    from folioquery.functions.answers import parse_golds

    name, kind = F.col("c_name"), F.col("c_custkey") % 5
    spelled = (
        F.when(kind == 0, F.concat(F.lit("['"), name, F.lit("', \""), "c_mktsegment", F.lit("\"]")))
        .when(kind == 1, name)
        .when(kind == 2, F.concat(F.lit("[\u2018"), name, F.lit("\u2019, 'x']")))
        .when(kind == 3, F.concat(F.lit('["'), name, F.lit('", null, 5]')))
        .otherwise(F.concat(F.lit("[['"), name, F.lit("', 'y']]")))
    )
    return table(spark, folder, "customer").select("c_custkey", parse_golds(spelled).alias("g")).select(
        "c_custkey", F.array_join(F.transform("g", lambda x: x["text"]), "|").alias("golds"),
        F.size(F.get("g", F.lit(0))["items"]).alias("n_items"),
    )


# ---- judge rows, runs, resume -------------------------------------------------------------

@query("judge_rows", """
WITH kept AS (
  SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS nth FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
ctx AS (
  SELECT conv_id, count(*) AS n_contexts, sum(length(text))::BIGINT AS n_chars FROM kept
  WHERE total <= 2000 OR nth = 1 GROUP BY 1
)
SELECT conv_id, n_contexts, n_chars, quality::VARCHAR AS response, toxic::VARCHAR AS reference
FROM ctx JOIN labels ON doc_id = conv_id WHERE toxic <> 1""")
def judge_rows(spark, folder):
    """Turns as contexts, labels as answer and reference; toxic ones have no reference."""
    labels = table(spark, folder, "labels")
    answers = labels.select(
        F.col("doc_id").alias("question"), F.col("quality").cast("string").alias("final_answer")
    )
    gold = labels.select(
        F.col("doc_id").alias("question"),
        A.golds_of(F.array(
            F.when(F.col("toxic") == 1, "N/A").otherwise(F.col("toxic").cast("string"))
        )).alias("golds"),
    )
    contexts = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("question"), F.col("turn").alias("ordinal"), "text"
    )
    rows = evaluation.judge_rows(answers, gold, contexts, cap=2000)
    return rows.select(
        F.col("user_input").alias("conv_id"),
        F.size("retrieved_contexts").cast("long").alias("n_contexts"),
        F.aggregate("retrieved_contexts", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
        .alias("n_chars"),
        "response", "reference",
    )


@query("latest_answers", """
SELECT md5(text) AS question_hash, max(doc_id) AS doc_id FROM documents GROUP BY text""")
def latest_answers(spark, folder):
    """Equal texts are one question; the later answer wins."""
    run = table(spark, folder, "documents").select(F.col("text").alias("question"), "doc_id")
    return evaluation.latest_answers(run, "doc_id").select(
        F.md5(F.col("question").cast("binary")).alias("question_hash"), "doc_id"
    )


@query("run_counters", """
SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS n_na,
  count(*) FILTER (event_type = 'error') AS n_error FROM events""")
def run_counters(spark, folder):
    run = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "N/A").otherwise(F.col("event_type"))
        .alias("final_answer"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    return evaluation.run_counters(run)


@query("resume_pending", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_pending(spark, folder):
    """Documents a rerun still has to process when the labelled ones are done."""
    return stages.pending(
        table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), ["doc_id"]
    )


@query("resume_answers", """
SELECT e.event_id FROM events e
WHERE e.user_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' AND value > 200)
   OR e.user_id IS NULL""")
def resume_answers(spark, folder):
    """Rows whose question has no answer yet; failed answers do not count."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    failed = (F.col("event_type") == "error") | ~F.coalesce(F.col("value") > 200, F.lit(False))
    done = stages.answered(events.select(
        F.col("user_id").alias("question"), F.when(failed, "x").alias("error")
    ))
    asked = events.select("event_id", F.col("user_id").alias("question"))
    return stages.pending(asked, done, ["question"]).select("event_id")


@query("question_fields", """
SELECT conv_id, turn,
  coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), CASE WHEN role <> 'user' THEN text END) AS question,
  coalesce(nullif(CASE WHEN role = 'user' THEN '' END, ''), CASE WHEN role <> 'user' THEN 'number' END, 'name') AS kind
FROM conversations""")
def question_fields(spark, folder):
    """Question records of either spelling brought to one form."""
    user = F.col("role") == "user"
    raw = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(user, F.col("text")).alias("text"),
        F.when(~user, F.col("text")).alias("question"),
        F.when(user, "").alias("kind"), F.when(~user, "number").alias("schema"),
    )
    return stages.question_fields(raw).select("conv_id", "turn", "question", "kind")


@query("company_lookup", """
SELECT o_orderkey AS doc_id, c_name AS company FROM orders
LEFT JOIN (
  SELECT c_custkey // 3 AS key, max_by(c_name, c_custkey) AS c_name FROM customer GROUP BY 1
) ON key = o_custkey""")
def company_lookup(spark, folder):
    """Reports with their company by file name; three rows name a file and the last counts; unknown files keep a null."""
    from folioquery.operators.elements import attach_company

    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("c"), "o_custkey", F.lit(".v1.pdf")).alias("source_pdf"),
    )
    metadata = table(spark, folder, "customer").select(
        F.concat(F.lit("eval/c"), F.expr("c_custkey div 3"), F.lit(".v1.pdf")).alias("filename"),
        F.col("c_name").alias("company"), F.col("c_custkey").alias("csv_ord"),
    )
    return attach_company(docs, metadata).select("doc_id", "company")
