"""Benchmark decontamination: word windows of a test set looked up in every training document (DataFrame functions only).

Every benchmark item gives its windows of ``size`` consecutive words; an item of fewer, but not none, is one
window. Distinct windows with their items are broadcast as a hash set if their measured size is below
``BROADCAST_BYTES``; a larger benchmark is joined by shuffle on the hash. Documents are read once: each word
position is a candidate for each window length in use, found by the hash of its words and then verified word
by word. Only hits, and one row for each document, are shuffled; they meet by document.

Defined cases: null and empty texts have no words and no hits; null items and items without words have no
windows; repeated items count each; repeated documents, also of equal ``doc_id``, are judged row by row; a
null ``doc_id`` is passed through; empty tables give empty results (an empty benchmark: no hits); other
columns are ignored by :func:`scan` and kept by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free, or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_BYTES = 64 << 20


def words(col: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(col), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``win`` (words), ``len``, ``items``: one row for each distinct window."""
    items = benchmark.select("item_id", words(or_empty()).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    at = items.withColumn("len", n).select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    wins = at.select("item_id", F.slice("w", F.col("i"), F.col("len")).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))
    return wins.select("win", F.size("win").alias("len"), "items")


def _hash(array: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.col(array)[at + k] for k in range(n)])


def _hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """For each row of ``docs``: one row with ``at`` -1 and ``n_words``, and one for each verified hit."""
    wins = benchmark_windows(benchmark, size)
    spark = docs.sparkSession
    # one row for each length, at most ``size`` of them
    stat = wins.groupBy("len").agg(F.sum(F.length(F.array_join("win", " ")) + 8 * F.size("items") + 64).alias("b")).collect()
    lengths, held = sorted(r["len"] for r in stat), sum(r["b"] for r in stat)
    if not lengths:
        wins = spark.createDataFrame([], wins.schema)
    hashed = F.lit(0).cast("bigint")
    for n in lengths:
        hashed = F.when(F.col("len") == n, _hash("win", F.lit(0), n)).otherwise(hashed)
    wins = wins.withColumn("hash", hashed)
    if held <= BROADCAST_BYTES:
        wins = F.broadcast(wins)
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(or_empty()).alias("w"))
    at = d.select("rid", "doc_id", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    if len(lengths) == 1:
        n = lengths[0]
        at = at.withColumn("len", F.lit(n))
        key = F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("w")), _hash("w", F.col("at"), n))
        at = at.withColumn("hash", key)
    else:
        cand = [F.struct(F.lit(n).alias("len"), F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("w")), _hash("w", F.col("at"), n)).alias("hash"))
                for n in lengths or [size]]
        at = at.select("rid", "doc_id", "w", "at", F.explode(F.array(*cand)).alias("c")).select("rid", "doc_id", "w", "at", "c.len", "c.hash")
        at = at.filter((F.col("at") >= 0) | (F.col("len") == (lengths or [size])[0]))
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.len") == F.col("b.len"))
    # the words are compared after the join: as a join key they would be cut out at every position
    found = at.alias("a").join(wins.alias("b"), same, "left")
    found = found.filter((F.col("a.at") == -1) | (F.slice("a.w", F.col("a.at") + 1, F.col("a.len")) == F.col("b.win")))
    return found.select("rid", "doc_id", "at", F.col("a.len").alias("len"), F.when(F.col("at") == -1, F.size("w")).alias("n_words"), F.col("b.items").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans`` for every row of ``docs``.

    ``hit_spans``: ``(first word, words)`` of each hit, sorted; bounded by the words of the document."""
    per = _hits(docs, benchmark, size).groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "len")))).alias("hit_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc, x):
        stop = x["at"] + x["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], x["at"]))).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    n_hit = F.aggregate("hit_spans", start, cover)["n"]
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return per.select(
        "rid", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"), "hit_spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, spans: bool = False) -> DataFrame:
    """The rows of ``docs`` without a hit; with ``spans``, all rows, hit words cut out of the contaminated texts.

    The judgement depends on the text alone and joins back by its hash and length beside ``doc_id``."""
    key, own_id, own_key, spans_at = free(docs.columns, "text_key", "hit_id", "hit_key", "hit_spans")
    marked = docs.withColumn(key, F.xxhash64(or_empty(), F.length(or_empty())))
    dirty = scan(marked.select(F.struct("doc_id", F.col(key).alias("text_key")).alias("doc_id"), "text"), benchmark, size).filter("contaminated")
    dirty = dirty.select(F.col("doc_id.doc_id").alias(own_id), F.col("doc_id.text_key").alias(own_key), F.col("hit_spans").alias(spans_at)).dropDuplicates([own_id, own_key])
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    if not spans:
        return marked.join(dirty, same, "left_anti").drop(key)
    both = marked.join(dirty, same, "left")
    raw = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    covered = F.flatten(F.transform(spans_at, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), covered)
    rebuilt = F.concat(gaps[0], F.array_join(F.transform(kept, lambda i: F.concat(raw[i], gaps[i + 1])), ""))
    text = F.when(F.col(spans_at).isNull(), F.col("text")).otherwise(rebuilt).alias("text")
    return both.select(*[text if c == "text" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
pos AS (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
cand AS (SELECT rid, doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT c.rid, c.i, c.n, w.item_id FROM cand c JOIN win w ON c.n = w.n AND c.s = w.s),
cov AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
