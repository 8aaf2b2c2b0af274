"""SQL fragments that state the text rules and derived inputs for the check engine."""

from __future__ import annotations

from folioquery.functions.text import (
    CONTROL_PATTERN, LEXICAL_PATTERN, NUMBER_PATTERN, TOKEN_PATTERN, UNRECOGNIZABLE_PATTERN,
    WHITESPACE, WHITESPACE_CLASS,
)
from folioquery.plans.derived import LINES_PER_PAGE

NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def normalize(x: str) -> str:
    x = f"regexp_replace({x}, '{CONTROL_PATTERN}', '', 'g')"
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(fi|fl) ([a-z])', '\1\2\3', 'g')"
    x = f"replace({x}, chr(160), ' ')"
    x = rf"regexp_replace({x}, '[ \t]+\n', {NL}, 'g')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', {NL}||{NL}, 'g')"
    return strip(x)


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_PATTERN}'))"


def lexical(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{LEXICAL_PATTERN}')"


def numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '{NUMBER_PATTERN}')"


def extracted(x: str) -> str:
    return f"length(regexp_replace({x}, '[{WHITESPACE_CLASS}]', '', 'g'))"


def recognizable(x: str) -> str:
    return f"length(regexp_replace({x}, '{UNRECOGNIZABLE_PATTERN}', '', 'g'))"


LINES = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS line,
         generate_subscripts(string_split(text, {NL}), 1) - 1 AS seq
  FROM documents
)"""

# One layout entry per line, as derived for the Spark side.
ENTRIES = LINES + f""",
entries AS (
  SELECT *, CASE WHEN n <= 40 THEN 'text' WHEN n % 11 = 4 THEN 'table' WHEN n % 11 = 7 THEN 'image'
                 WHEN n % 11 = 9 THEN 'equation' ELSE 'text' END
            AS rtype,
         CASE WHEN n <= 14 THEN 1 WHEN n <= 27 THEN 2 WHEN n <= 40 THEN 3 END AS tlevel,
         seq // {LINES_PER_PAGE} AS page_idx
  FROM (SELECT *, length({strip('line')}) AS n FROM lines)
)"""

ELEMENTS = ENTRIES + f""",
kept AS (
  SELECT * FROM (
    SELECT doc_id, seq, page_idx + 1 AS page, line, rtype,
      CASE WHEN rtype = 'text' AND tlevel IS NOT NULL THEN 'heading' WHEN rtype = 'text' THEN 'paragraph'
           WHEN rtype = 'image' THEN 'picture' ELSE rtype END AS type,
      CASE WHEN rtype = 'table' THEN {strip("substr(line, 1, 12) || ' ' || substr(line, 13, 12)")}
           ELSE {strip('line')} END AS text,
      CASE WHEN rtype = 'text' THEN coalesce(tlevel, 0) ELSE 0 END AS level
    FROM entries)
  WHERE type IN ('table', 'picture') OR text <> ''
),
elements AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx, page, type, text,
    level,
    CASE WHEN type = 'table' THEN 't' || (sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY seq) - 1)::BIGINT END AS table_id,
    CASE WHEN type = 'table' THEN '<table><tr><td>' || line || '</td></tr></table>' END AS html,
    CASE WHEN type = 'picture' THEN 'img/' || seq || '.jpg' END AS img
  FROM kept
),
normal AS (SELECT * REPLACE ({normalize('text')} AS text) FROM elements)"""

# Breadcrumbs: a heading is live until the next one at its level or above.
CRUMBS = ELEMENTS + """,
heads AS (
  SELECT h.doc_id, h.idx, h.text, min(g.idx) AS stop
  FROM normal h LEFT JOIN normal g
    ON g.doc_id = h.doc_id AND g.type = 'heading' AND g.idx > h.idx AND g.level <= h.level
  WHERE h.type = 'heading' GROUP BY h.doc_id, h.idx, h.text
),
prose AS (
  SELECT p.doc_id, p.idx, p.page, p.text,
    coalesce(string_agg(h.text, ' > ' ORDER BY h.idx), '') AS crumb
  FROM normal p LEFT JOIN heads h
    ON h.doc_id = p.doc_id AND h.idx < p.idx AND (h.stop IS NULL OR p.idx < h.stop)
  WHERE p.type NOT IN ('heading', 'table', 'picture') AND p.text <> ''
  GROUP BY p.doc_id, p.idx, p.page, p.text
)"""

# Greedy packing and word windows as recursions; chunk size 300, overlap 50.
CHUNKS = CRUMBS.replace("\nlines AS", "\nRECURSIVE_MARK lines AS", 1) + f""",
atoms AS (
  SELECT *, {tokens('text')} AS t, greatest(300 - {tokens('crumb')}, 64) AS b,
    row_number() OVER w AS k,
    coalesce(lag(crumb) OVER w <> crumb, true) AS brk
  FROM prose WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
),
walk AS (
  SELECT doc_id, k, idx AS gs, CASE WHEN t > b THEN -1 ELSE t END AS cur FROM atoms WHERE k = 1
  UNION ALL
  SELECT a.doc_id, a.k,
    CASE WHEN a.brk OR a.t > a.b OR w.cur < 0 OR w.cur + a.t > a.b THEN a.idx ELSE w.gs END,
    CASE WHEN a.t > a.b THEN -1 WHEN a.brk OR w.cur < 0 OR w.cur + a.t > a.b THEN a.t
         ELSE w.cur + a.t END
  FROM walk w JOIN atoms a ON a.doc_id = w.doc_id AND a.k = w.k + 1
),
packed AS (
  SELECT a.doc_id, w.gs, any_value(a.crumb) AS crumb, arg_min(a.page, a.idx) AS page,
    max(a.idx) + 1 AS els_end, string_agg(a.text, {NL}||{NL} ORDER BY a.idx) AS body,
    bool_or(a.t > a.b) AS over, any_value(a.b) AS b
  FROM atoms a JOIN walk w USING (doc_id, k) GROUP BY a.doc_id, w.gs
),
words AS (
  SELECT doc_id, gs, b, unnest(string_split(body, ' ')) AS word,
    generate_subscripts(string_split(body, ' '), 1) AS p
  FROM packed WHERE over
),
costs AS (
  SELECT doc_id, gs, b, p,
    (sum({tokens('word')} + 1) OVER (PARTITION BY doc_id, gs ORDER BY p))::BIGINT AS cs
  FROM words
  UNION ALL SELECT doc_id, gs, b, 0, 0 FROM packed WHERE over
),
reach AS (
  SELECT doc_id, gs, p,
    max(p) OVER (PARTITION BY doc_id, gs ORDER BY cs RANGE BETWEEN UNBOUNDED PRECEDING AND b FOLLOWING)
      + 1 AS stop,
    min(p) OVER (PARTITION BY doc_id, gs ORDER BY cs RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)
      + 1 AS tail,
    max(p) OVER (PARTITION BY doc_id, gs) AS n
  FROM costs
),
windows AS (
  SELECT doc_id, gs, 0 AS frag, 1::BIGINT AS s, greatest(stop, 2)::BIGINT AS e, n FROM reach WHERE p = 0
  UNION ALL
  SELECT w.doc_id, w.gs, w.frag + 1, greatest(w.s, t.tail)::BIGINT,
    greatest(r.stop, w.e + 1)::BIGINT, w.n
  FROM windows w
  JOIN reach t ON t.doc_id = w.doc_id AND t.gs = w.gs AND t.p = w.e - 1
  JOIN reach r ON r.doc_id = w.doc_id AND r.gs = w.gs AND r.p = greatest(w.s, t.tail) - 1
  WHERE w.e <= w.n
),
cut AS (
  SELECT w.doc_id, w.gs, w.frag, array_to_string(string_split(p.body, ' ')[w.s:w.e - 1], ' ') AS body
  FROM windows w JOIN packed p USING (doc_id, gs)
),
bodies AS (
  SELECT doc_id, gs, 0 AS frag, body FROM packed WHERE NOT over
  UNION ALL SELECT * FROM cut
),
ser AS (
  SELECT doc_id, idx, page, table_id, text AS caption,
    array_to_string(list_filter(string_split(
      regexp_replace(html, '</?t[a-z]+>', '', 'g'), '. '), lambda x: length(x) > 0), {NL}) AS blocks,
    html, caption_raw
  FROM (SELECT n.* , e.text AS caption_raw FROM normal n JOIN elements e USING (doc_id, idx)
        WHERE n.type = 'table')
),
units AS (
  SELECT doc_id, idx, page, 'serialized_table' AS type,
    CASE WHEN blocks <> '' THEN
      CASE WHEN caption_raw <> '' THEN 'Table: ' || caption_raw || {NL} ELSE '' END || blocks
      ELSE caption END AS unit, table_id
  FROM ser
  UNION ALL
  SELECT e.doc_id, e.idx, e.page, 'serialized_image', 'Reading of ' || e.text, NULL::VARCHAR
  FROM elements e WHERE e.type = 'picture' AND e.text <> ''
),
raw_chunks AS (
  SELECT p.doc_id, 'content' AS type, p.page,
    CASE WHEN p.crumb <> '' THEN p.crumb || {NL}||{NL} ELSE '' END || x.body AS text,
    p.gs AS els_start, p.els_end, x.frag, NULL::VARCHAR AS table_id
  FROM bodies x JOIN packed p USING (doc_id, gs)
  UNION ALL
  SELECT doc_id, type, page, unit, idx, idx + 1, 0, table_id FROM units WHERE trim(unit) <> ''
),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY els_start, frag) - 1 AS chunk_id,
    type, page, text, els_start, els_end, table_id, {tokens('text')} AS length_tokens
  FROM raw_chunks
),
page_parts AS (
  SELECT doc_id, page, idx,
    CASE WHEN type = 'heading' THEN repeat('#', least(level, 4)) || ' ' || text ELSE text END AS part
  FROM normal WHERE type NOT IN ('table', 'picture') AND text <> ''
  UNION ALL SELECT doc_id, page, idx, unit FROM units
    WHERE type = 'serialized_table' AND trim(unit) <> ''
  UNION ALL
  SELECT n.doc_id, n.page, n.idx, CASE WHEN u.unit IS NULL THEN n.text
    WHEN n.text = '' THEN u.unit ELSE n.text || {NL} || u.unit END
  FROM normal n LEFT JOIN units u ON u.doc_id = n.doc_id AND u.idx = n.idx
  WHERE n.type = 'picture' AND (n.text <> '' OR u.unit IS NOT NULL)
),
page_texts AS (
  SELECT doc_id, page, string_agg(part, {NL}||{NL} ORDER BY idx) AS text
  FROM page_parts GROUP BY doc_id, page
)"""
CHUNKS = CHUNKS.replace("RECURSIVE_MARK ", "RECURSIVE ")
