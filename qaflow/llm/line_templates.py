"""Line dedup with a log-template tree (DataFrame functions only).

A line is cut into tokens at white space; a token with a digit is the variable field ``<*>``. The tree has a
fixed depth: token count, then the first ``DEPTH`` tokens; a leaf holds the lines that agree in these. Inside a
leaf a position is constant for a line if its token stands there in at least ``min_docs`` lines, else it is a
variable field. Lines with the same constants have one template. A template is *recurring* if at least
``similarity`` of its positions are constant and its lines come from ``min_docs`` or more documents; its lines are
dropped from every document but the first (smallest ``doc_id``, then text hash).

Leaves below ``min_docs`` lines are left aside before any token is looked at, equal lines are counted once, tokens
travel as 64-bit hashes, and templates are combined by aggregates, never collected.

:func:`drop_lines` follows the SQL, where ``<*>`` counts as a constant: lines of figures only share one template, so
lines of other contents go too. :func:`without_repeated_lines`, the stage of the pipeline, counts literal tokens only
(``literal``); lines with fewer of them, and long lines without blanks, are dropped only if they are equal, digits and
all. It leaves documents whole that are copies of one other document (``COPY`` of their characters, of similar length):
the near-duplicate join behind it removes them as documents.

Defined cases: a null text stays null (no lines); blank lines and lines below ``MIN_TOKENS`` tokens stay; documents
are told apart by ``doc_id`` and text, so repeated rows count as one document and are treated alike; a null ``doc_id``
sorts first; empty tables give empty results; other columns are kept as they are, ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, saved

DEPTH, MIN_TOKENS, MIN_DOCS, SIMILARITY = 3, 3, 3, 0.8
COPY = 0.8  # share of a document's characters in the lines of one other, from which it is a copy as a whole
SOLID_CHARS = 16  # a line without blanks (Chinese, Japanese) counts as MIN_TOKENS tokens from so many characters on


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, th, pos, norm, n, leaf`` of every line of ``MIN_TOKENS`` or more tokens."""
    text = F.when(F.col("text").rlike(r"  |[\t\x0B\f\r]"), F.regexp_replace("text", r"[ \t\x0B\f\r]+", " ")).otherwise(F.col("text"))
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("norm"))
    d = d.withColumn("norm", F.when(F.col("norm").rlike("[0-9]"), F.regexp_replace("norm", r"(?<!\S)[^\s0-9]*+[0-9]\S*", "<*>")).otherwise(F.col("norm")))
    # prepared before the lines are laid out, where no filter can make it run twice
    d = d.select("doc_id", "th", F.posexplode(F.transform(F.split("norm", "\n"), F.trim)).alias("pos", "norm"))
    d = d.withColumn("n", F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1)
    return d.filter(F.col("n") >= MIN_TOKENS).select("doc_id", "th", "pos", "norm", "n", F.xxhash64("n", F.substring_index("norm", " ", DEPTH)).alias("leaf"))


def _equal(docs: DataFrame) -> DataFrame:
    """``doc_id, th, pos, template`` of every line of ``MIN_TOKENS`` tokens or ``SOLID_CHARS`` characters without a blank; equal lines (but for the blanks) have one template."""
    text = F.regexp_replace("text", r"[ \t\x0B\f\r]+", " ")
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(F.split(text, "\n"), F.trim)).alias("pos", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return d.filter((n >= MIN_TOKENS) | (n == 1) & (F.length("line") >= SOLID_CHARS)).select("doc_id", "th", "pos", F.xxhash64("line").alias("template"))


def _later(placed: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id, th, pos, first`` of the lines whose template is in ``min_docs`` documents, in all but the first of these."""
    seen = placed.groupBy("template", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    recurring = seen.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "th")).alias("first")).filter(F.col("docs") >= min_docs)
    later = ~F.struct("doc_id", "th").eqNullSafe(F.col("first"))
    return placed.join(recurring, "template").filter(later).select("doc_id", "th", "pos", "first")


def _counts(token, literal: bool):
    """Whether a constant token counts towards the similarity."""
    return token != "<*>" if literal else F.lit(True)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, literal: bool = False) -> DataFrame:
    """``doc_id, th, positions``: the lines to drop of each document that has some (0-based, no repeats)."""
    lines = _lines(docs)
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_docs).select("leaf")
    held = saved(lines.join(leaves, "leaf", "left_semi").withColumn("h", F.xxhash64("norm")), "template-lines")
    equal = held.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("c"), F.min("norm").alias("norm"))
    tokens = equal.select("leaf", "h", "c", F.posexplode(F.slice(F.split("norm", " "), F.lit(DEPTH + 1), F.lit(1 << 30))).alias("at", "token"))
    tokens = tokens.select("leaf", "h", "c", F.xxhash64("leaf", "at", "token").alias("field"), _counts(F.col("token"), literal).alias("counts"))
    constant = tokens.groupBy("field").agg(F.sum("c").alias("c")).filter(F.col("c") >= min_docs).select("field")
    # what is not constant adds nothing to the template
    kept = tokens.join(constant, "field").groupBy("leaf", "h").agg(F.bit_xor(F.xxhash64("field")).alias("x"), F.count(F.when(F.col("counts"), 1)).alias("k"))
    lead = F.size(F.filter(F.split(F.substring_index("norm", " ", DEPTH), " "), lambda t: _counts(t, literal))) if literal else F.least("n", F.lit(DEPTH))
    sizes = held.select("leaf", "h", "n", "doc_id", "th", "pos", lead.alias("lead")).join(kept, ["leaf", "h"], "left")
    enough = F.coalesce("k", F.lit(0)) + F.col("lead") >= F.col("n") * similarity
    placed = sizes.filter(enough).select("doc_id", "th", "pos", F.xxhash64("leaf", F.coalesce("x", F.lit(0))).alias("template"))
    placed = saved(placed, "placed-lines")
    out = _later(placed, min_docs)
    if literal:
        out = out.unionByName(_later(saved(_equal(docs), "equal-lines"), min_docs))
    return out.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("positions"), *([F.collect_set(F.struct("pos", "first")).alias("origins")] if literal else []))


def _without_copies(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` less the documents that are copies as a whole: ``COPY`` of their characters or more stand in lines that one and
    the same document has first, and that document is not much longer. Such a copy is the business of a document-level join;
    without its lines it could no longer be found there, and its rest would stay as a document of its own."""
    length = F.coalesce(F.length("text"), F.lit(0))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("th"), length.alias("size"), F.transform(F.split("text", "\n"), F.length).alias("long")).dropDuplicates(["doc_id", "th"])
    own = sizes.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "size", "long")
    lines = gone.join(own, gone["doc_id"].eqNullSafe(own["of"]) & (gone["th"] == own["of_th"])).select("doc_id", "th", "size", F.explode(F.transform("origins", lambda o: F.struct(o["pos"].alias("pos"), o["first"].alias("first"), F.col("long")[o["pos"]].alias("n")))).alias("o"))
    # a line may have two templates; it counts once for a document that is the first of both
    lines = lines.groupBy("doc_id", "th", "size", F.col("o.first.doc_id").alias("first"), F.col("o.first.th").alias("first_th"), F.col("o.pos").alias("pos")).agg(F.max("o.n").alias("n"))
    shares = lines.groupBy("doc_id", "th", "size", "first", "first_th").agg((F.sum("n") + F.count(F.lit(1))).alias("n")).filter((F.col("n") >= F.col("size") * COPY))
    firsts = sizes.select(F.col("doc_id").alias("f"), F.col("th").alias("f_th"), F.col("size").alias("first_size"))
    copies = shares.join(firsts, F.col("first").eqNullSafe(F.col("f")) & (F.col("first_th") == F.col("f_th"))).filter(F.col("first_size") * COPY <= F.col("size"))
    copies = copies.select(F.col("doc_id").alias("c"), F.col("th").alias("c_th")).distinct()
    return gone.join(copies, gone["doc_id"].eqNullSafe(copies["c"]) & (gone["th"] == copies["c_th"]), "left_anti")


def _after(docs: DataFrame, names: list[str], min_docs: int, similarity: float, literal: bool = False) -> DataFrame:
    """``docs`` with three columns of the given names: its lines, the positions that go (or null), and the text after the drop."""
    lines, gone_at, new = names
    own_hash, other_id, other_hash = free([*docs.columns, *names], "text_hash", "line_id", "line_hash")
    gone = dropped_lines(docs, min_docs, similarity, literal)
    if literal:
        gone = _without_copies(docs, saved(gone, "dropped-lines"))
    gone = gone.select(F.col("doc_id").alias(other_id), F.col("th").alias(other_hash), F.col("positions").alias(gone_at))
    marked = docs.withColumn(own_hash, F.xxhash64("text"))
    both = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(own_hash) == F.col(other_hash)), "left").withColumn(lines, F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at)
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    return both.withColumn(new, text)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, ``text`` after the drop."""
    out = _after(docs.select("doc_id", "text"), ["lines", "gone", "new"], min_docs, similarity)
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint")
    n_dropped = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("bigint")
    return out.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.col("new").alias("text"))


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with shortened texts (``n_chars`` follows); a document that loses all it has goes, one that is a copy as a whole stays whole."""
    names = free(docs.columns, "lines", "gone", "new")
    _, gone, new = names
    out = _after(docs, names, min_docs, similarity, literal=True).filter(F.col(gone).isNull() | (F.trim(new) != ""))
    length = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(new)) if "n_chars" in docs.columns else None
    return out.select(*[F.col(new).alias(c) if c == "text" else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (SELECT r, doc_id, text, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
           FROM (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS parts FROM documents)),
n AS (SELECT r, doc_id, text, pos, line, string_split(regexp_replace(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM l),
q AS (SELECT r, doc_id, text, pos, t, len(t) AS n, t[1:3] AS lead FROM n WHERE len(t) >= 3),
leaf AS (SELECT n, lead FROM q GROUP BY ALL HAVING count(*) >= 3),
h AS (SELECT q.* FROM q JOIN leaf USING (n, lead)),
e AS (SELECT n, lead, t, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM h),
f AS (SELECT n, lead, k, token FROM e WHERE k > 3 GROUP BY ALL HAVING count(*) >= 3),
eq AS (SELECT DISTINCT n, lead, t FROM h),
ee AS (SELECT n, lead, t, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM eq),
tp AS (SELECT ee.n, ee.lead, ee.t, string_agg(CASE WHEN ee.k <= 3 OR f.k IS NOT NULL THEN 'c' || ee.token ELSE '*' END, ' ' ORDER BY ee.k) AS tmpl,
              count(*) FILTER (WHERE ee.k <= 3 OR f.k IS NOT NULL) AS k
       FROM ee LEFT JOIN f ON ee.n = f.n AND ee.lead = f.lead AND ee.k = f.k AND ee.token = f.token GROUP BY 1, 2, 3),
o AS (SELECT h.r, h.doc_id, h.text, h.pos, h.n, tp.tmpl FROM h JOIN tp ON h.n = tp.n AND h.lead = tp.lead AND h.t = tp.t WHERE tp.k >= h.n * 0.8),
rc AS (SELECT n, tmpl, min(doc_id) AS first FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT DISTINCT o.r, o.pos FROM o JOIN rc ON o.n = rc.n AND o.tmpl = rc.tmpl WHERE o.doc_id <> rc.first)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g ON l.r = g.r AND l.pos = g.pos GROUP BY l.r, l.doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
