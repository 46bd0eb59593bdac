"""Independent DuckDB SQL for the registered queries (the correctness oracle).

The SQL restates each operator's semantics on the raw tables with plain joins and
window functions; it is only used to check the Spark plans at small scale.
"""

from __future__ import annotations

from .. import constants as K


def lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)``."""
    parts = s.split("\n")
    out = []
    for i, p in enumerate(parts):
        if p:
            out.append("'" + p.replace("'", "''") + "'")
        if i < len(parts) - 1:
            out.append("chr(10)")
    return " || ".join(out) if out else "''"


def redact(x: str) -> str:
    token = lit(K.REDACTION_TOKENS["Financial information"])
    return f"regexp_replace({x}, '\\b\\d{{4}} \\d{{4}} \\d{{4}} \\d{{4}}\\b', {token}, 'g')"


POINTS = """
points AS (
  SELECT e.vec_id AS id, e.embedding AS vector, CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, e.label,
         d.lang, d.source,
         CASE WHEN p.page_id IS NOT NULL THEN coalesce(nullif(regexp_extract(p.html, '(?s)<title>(.*?)</title>', 1), ''),
              'Title: ' || CAST(d.doc_id AS VARCHAR)) END AS title,
         CASE WHEN p.page_id IS NOT NULL THEN coalesce(p.url, '') END AS url,
         p.page_id IS NOT NULL AS has_meta
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = e.vec_id
)"""

_DIGITS = "lpad(CAST(o.o_orderkey * 7919 + o.o_custkey AS VARCHAR), 16, '0')"
_SPACED = (f"substr({_DIGITS}, 1, 4) || ' ' || substr({_DIGITS}, 5, 4) || ' ' || substr({_DIGITS}, 9, 4) || ' ' || "
           f"substr({_DIGITS}, 13, 4)")
QUESTION_TEXT = (
    "'Order ' || CAST(o.o_orderkey AS VARCHAR) || ' was placed on ' || strftime(o.o_orderdate, '%Y-%m-%d') || '. ' || "
    f"coalesce(CASE WHEN o.o_orderstatus = 'F' THEN 'My card number is ' || {_SPACED} || '. ' END, '') || "
    f"coalesce(CASE WHEN o.o_orderstatus = 'O' THEN 'Reference ' || {_DIGITS} || '. ' END, '') || "
    "'What is the status of my ' || lower(o.o_orderpriority) || ' order?'"
)

QUESTIONS = f"""
questions AS (
  SELECT 'q' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0') AS event_id,
         coalesce({QUESTION_TEXT}, 'What is document ' || CAST(e.vec_id AS VARCHAR) || ' about?') AS user_query,
         e.label AS q_label, e.embedding AS qvec
  FROM embeddings e LEFT JOIN orders o ON e.vec_id = o.o_orderkey
)"""

DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def hits(k: int, label_filter: bool = True, where: str = "", offset: int = 0, threshold: float | None = None,
         points: str = "points") -> str:
    cond = "p.label = q.q_label" if label_filter else "TRUE"
    if where:
        cond += f" AND ({where})"
    thr = "" if threshold is None else f"WHERE score >= {threshold!r}"
    return f"""
scored AS (
  SELECT q.event_id, p.id, {DOT.format(a='q.qvec', b='p.vector')} AS score
  FROM questions q JOIN {points} p ON {cond}
),
ranked AS (
  SELECT event_id, id, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, id ASC) AS rn
  FROM scored {thr}
),
hits AS (
  SELECT event_id, id, score, CAST(rn - {offset} AS INTEGER) AS rank FROM ranked WHERE rn > {offset} AND rn <= {k + offset}
)"""


CTX = """
ctx AS (
  SELECT h.event_id, h.rank, h.score, p.doc_id, p.text, p.title, CASE WHEN p.has_meta THEN p.url END AS url, p.has_meta
  FROM hits h JOIN points p ON p.id = h.id
)"""


def fmt(text="text", title="title", url="url", has_meta="has_meta") -> str:
    return (f"CASE WHEN {has_meta} THEN '[title: ''' || coalesce({title}, 'None') || ''', url: ''' || "
            f"coalesce({url}, '') || ''']' || chr(10) || {text} || chr(10) ELSE coalesce({text}, 'None') || chr(10) END")


def consolidation(strategy: str, limit: int, tokens: str = "length(fmt)", src: str = "ctx") -> str:
    if strategy == "score_weighted":
        order = "score DESC NULLS LAST, rank ASC"
    elif strategy == "simple":
        order = "flen ASC, rank ASC"
    else:
        order = "rank ASC"
    return f"""
cf AS (SELECT c.*, {fmt()} AS fmt FROM {src} c),
cl AS (SELECT *, length(fmt) AS flen, CAST({tokens} AS BIGINT) AS ntok FROM cf),
cs AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY {order}) - 1 AS INTEGER) AS spos FROM cl),
cc AS (SELECT *, sum(ntok) OVER (PARTITION BY event_id ORDER BY spos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              count(*) OVER (PARTITION BY event_id) AS n FROM cs),
co AS (SELECT *, min(CASE WHEN cum > {limit} THEN spos END) OVER (PARTITION BY event_id) AS fo FROM cc),
cmsg AS (SELECT event_id, 'token_limit={limit} Documents: ' ||
                string_agg('(i=''' || doc_id || ''' length=' || CAST(ntok AS VARCHAR) || ')', ',' ORDER BY spos) AS msg
         FROM co GROUP BY event_id),
cons AS (
  SELECT co.event_id, rank, doc_id, title, url, has_meta, score,
         (fo IS NOT NULL AND fo < n - 1) AS is_err,
         CASE WHEN (fo IS NOT NULL AND fo < n - 1) AND spos >= fo THEN text ELSE fmt END AS out_text,
         CAST(CASE WHEN (fo IS NOT NULL AND fo < n - 1) THEN rank - 1 ELSE spos END AS INTEGER) AS pos,
         CASE WHEN (fo IS NOT NULL AND fo < n - 1) THEN cmsg.msg END AS error
  FROM co JOIN cmsg ON cmsg.event_id = co.event_id
  WHERE fo IS NULL OR fo < n - 1 OR spos < fo
)"""


def ref_line(pos="pos", has_meta="has_meta", title="title", url="url", doc_id="doc_id") -> str:
    return (f"CAST({pos} AS VARCHAR) || '. ' || CASE WHEN {has_meta} THEN {title} || ': ' || {url} "
            f"ELSE {doc_id} END || chr(10)")


def prompt(user_query: str, context: str, template: str = "basic") -> str:
    if template == "basic":
        head, rest = K.PROMPT_BASIC.split("{user_query}")
        middle, tail = rest.split("{context}")
        body = f"{lit(head)} || {user_query} || {lit(middle)} || {context} || {lit(tail)}"
    else:
        body = f"{user_query} || {context}"
    return f"({body} || {lit(K.EOS_TOKEN)})"


def pipeline(k: int = 2, strategy: str = "simple", limit: int = 1000) -> str:
    """WITH-clause of the shipped four-stage pipeline without a model; final CTE ``pipe``."""
    no_docs = lit(K.NO_DOCUMENTS_PREFIX + K.FALLBACK_TAIL)
    return f"""WITH {POINTS.strip()},
{QUESTIONS.strip()},
{hits(k).strip()},
{CTX.strip()},
{consolidation(strategy, limit).strip()},
hl AS (SELECT event_id, string_agg(doc_id || ':' || CAST(CAST(score AS DECIMAL(18,6)) AS VARCHAR), ',' ORDER BY rank)
       AS hit_log FROM ctx GROUP BY event_id),
ev AS (SELECT event_id, string_agg(out_text, '' ORDER BY pos) AS ctx_text,
              string_agg({ref_line()}, '' ORDER BY pos) AS refs, bool_or(is_err) AS cons_err,
              string_agg(doc_id, ',' ORDER BY pos) AS ctx_ids
       FROM cons GROUP BY event_id),
base AS (
  SELECT q.event_id, {redact('q.user_query')} AS cleaned, hl.hit_log, hl.hit_log IS NOT NULL AS has_hits,
         ev.ctx_text, ev.refs, coalesce(ev.cons_err, FALSE) AS cons_err, ev.ctx_ids
  FROM questions q LEFT JOIN hl ON hl.event_id = q.event_id LEFT JOIN ev ON ev.event_id = q.event_id
),
pipe AS (
  SELECT event_id, cleaned AS cleaned_request, coalesce(hit_log, '') AS relevant_document_ids_scores,
         {prompt('cleaned', f"CASE WHEN has_hits THEN coalesce(ctx_text, '') ELSE {no_docs} END")} AS prompt,
         {lit(K.NO_MODEL_REFERENCES_PREFIX)} || CASE WHEN has_hits THEN coalesce(refs, '') ELSE '0. ' || chr(10) END
           AS generated_text,
         concat_ws(',', CASE WHEN NOT has_hits THEN {lit(K.NO_DOCUMENTS_ERROR)} END,
                   CASE WHEN cons_err THEN {lit(K.CONTEXT_WINDOW_ERROR)} END, 'ModelUnavailableError') AS error_types,
         CASE WHEN has_hits THEN coalesce(ctx_ids, '') ELSE '' END AS context_ids,
         has_hits, cons_err
  FROM base
)"""
