"""Phrase collocations of a corpus, from exact n-gram counts in counting quotient filters.

1. *Chunks*: each task lays its texts out as word numbers of its own, per language, with the list of those words: about
   four bytes a word, written once. Pieces end with the number 0.
2. *Vocabulary*: words with ``least`` or more occurrences in their language get dense ids; no phrase that counts holds
   another word. Ids are numbered in parts by hash, with offsets, so no task sees a whole language.
3. *Counting*: a chunk meets the ids of its words (a row for each distinct word of a chunk, however frequent it is) and
   counts its n-grams of 2 and 3 ids into one filter for each shard (see ``quotient_filter``).
4. *Merging*: the filters of a shard are merged, and entries with ``least`` or more occurrences leave it in the same task,
   so a merged filter is neither laid out again nor passed to a second Python worker. Shards are cut by permuted n-grams, so
   frequent words and large languages are spread evenly, and a shard has a bounded number of bytes however large the corpus is.
5. *Scoring*: these entries are joined with the counts of their parts.
   The first ``top`` of a language are found in two steps, over salted groups and over what these leave.

Defined cases: a null text has no words, a null language is ``und``; repeated rows count as often as they stand there; a
word may be of any length; phrases of equal score and count are in the order of their bytes; an empty table gives no rows;
other columns, whatever their names, are dropped. A language may have up to 2^32 words that count.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import byte_slices, saved

LEAST, TOP, INSIDE = 10, 2000, 50
CHUNK = 1 << 19  # words
HELD = 1 << 21  # words of all languages that a task holds
SHARD_BYTES, ENTRY_BYTES = 16 << 20, 20
SALTS = 32
#: upper case to lower case, tab to blank, what ends a piece to a line end
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
WORD = re.compile(rb"[^ \n]+|\n")
BREAK = b"\n"


class Chunk:
    """Word numbers of one language, and the words in the order of their numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[BREAK]
        self.codes = array("i")

    def add(self, text: bytes) -> None:
        self.codes.extend(map(self.ids.__getitem__, WORD.findall(text.translate(TABLE))))
        self.codes.append(0)


def chunks(docs: DataFrame) -> DataFrame:
    """``chunk, lang, words, counts, codes``: texts as numbers of the words of their chunk."""
    schema = pa.schema([("chunk", pa.string()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Chunk] = {}

        def flush(lang: str) -> pa.RecordBatch:
            own = held.pop(lang)
            counts = np.bincount(np.frombuffer(own.codes, np.int32), minlength=len(own.ids))
            words = [w.decode() for w in own.ids]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([words[1:]]), pa.array([counts[1:]]), pa.array([own.codes.tobytes()])], schema=schema)

        for batch in (s for b in batches for s in byte_slices(b, "text")):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = held.get(lang) or held.setdefault(lang, Chunk())
                own.add(text)
                if len(own.codes) >= CHUNK:
                    yield flush(lang)
            while sum(len(c.codes) for c in held.values()) > HELD:
                yield flush(max(held, key=lambda x: len(held[x].codes)))
        for lang in list(held):
            yield flush(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(run, "chunk string, lang string, words array<string>, counts array<bigint>, codes binary")


def vocabulary(laid: DataFrame, least: int) -> DataFrame:
    """``lang, word, c, id`` of the words that occur ``least`` times in their language; ids from 1 without gaps."""
    parts = max(64, int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = laid.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("c"))
    words = saved(each.filter(F.col("c") >= least).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts))), "phrase-words")
    sizes = words.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("lang", "part", (F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")).alias("before"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("lang", "part").orderBy("word"))
    return words.withColumn("own", own).join(before, ["lang", "part"]).select("lang", "word", "c", (F.col("before") + F.col("own")).alias("id"))


def filters(laid: DataFrame, words: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """``lang, shard, filter``: the counts of all n-grams of 2 and 3 ids, a filter for each chunk and shard."""
    found = laid.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), F.col("pos").cast("int").alias("pos"), "id")

    def count(chunk: pa.Table, ids: pa.Table) -> pa.Table:
        out: list[tuple[str, int, bytes]] = []
        if chunk.num_rows and ids.num_rows:
            codes = np.frombuffer(chunk.column("codes")[0].as_py(), np.int32)
            pos, known = ids.column("pos").to_numpy() + 1, ids.column("id").to_numpy()
            table = np.zeros(int(max(codes.max(), pos.max())) + 1, np.int64)
            table[pos] = known
            t = table[codes]
            two = (t[:-1] > 0) & (t[1:] > 0)
            three = two[:-1] & two[1:]
            grams = np.zeros((int(two.sum()) + int(three.sum()), 3), np.int64)
            n = int(two.sum())
            grams[:n, 0], grams[:n, 1] = t[:-1][two], t[1:][two]
            grams[n:, 0], grams[n:, 1], grams[n:, 2] = t[:-2][three], t[1:-1][three], t[2:][three]
            high, low, counts = qf.tallied(*qf.permuted(grams, bits), None, bits)
            if len(high):
                shard = (high >> np.uint64(bits - shard_bits)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
                lang = chunk.column("lang")[0].as_py()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((lang, int(shard[a]), qf.build(high[a:b], low[a:b], counts[a:b], bits, shard_bits)))
        return _table(out)

    return laid.select("chunk", "lang", "codes").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(count, "lang string, shard int, filter binary")


def _table(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    return pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "shard": pa.array([r[1] for r in rows], pa.int32()), "filter": pa.array([r[2] for r in rows], pa.binary())})


def frequent(counted: DataFrame, bits: int, least: int) -> DataFrame:
    """``lang, w1, w2, w3, a`` of the entries with ``least`` or more occurrences in the merged filters of a shard; ``w3`` is 0 for two words."""

    def run(rows: pa.Table) -> pa.Table:
        high, low, counts = qf.summed([memoryview(x.as_buffer()) for x in rows.column("filter")])
        often = counts >= least
        ids = qf.restored(high[often], low[often], bits)
        lang = pa.array([rows.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(ids), np.int32)))
        return pa.Table.from_arrays([lang, *(pa.array(ids[:, k]) for k in range(3)), pa.array(counts[often])], names=["lang", "w1", "w2", "w3", "a"])

    return counted.groupBy("lang", "shard").applyInArrow(run, "lang string, w1 bigint, w2 bigint, w3 bigint, a bigint")


def _score(a: str, left: str, right: str):
    """``floor(1000000 * a * a / (left * right))`` in whole numbers of up to 38 digits; at most 1000000, as no part is rarer than the phrase."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of 2 and 3 words of each language.

    A phrase within a longer one that has ``inside`` percent of its occurrences is left out."""
    laid = saved(chunks(docs), "phrase-chunks")
    total = laid.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = saved(vocabulary(laid, least), "phrase-vocabulary")
    widest, most = words.agg(F.max("id")).first()[0] or 1, total.agg(F.max("n")).first()[0] or 1
    bits = int(widest).bit_length()
    if bits > 32:
        raise ValueError(f"{widest} words of one language; ids have 32 bits")
    shard_bits = min(bits, max(3, (int(most) * ENTRY_BYTES // SHARD_BYTES).bit_length()))
    counts = saved(frequent(filters(laid, words, bits, shard_bits), bits, least), "phrase-counts")
    two, three = counts.filter("w3 = 0").drop("w3"), counts.filter("w3 > 0")

    def single(at: str, name: str) -> DataFrame:
        return words.select("lang", F.col("id").alias(at), F.col("c").alias(name))

    def pair(first: str, second: str, name: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name))

    longer = three.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("most"))
    alone = two.join(longer, ["lang", "w1", "w2"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    alone = alone.join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"]).select("lang", "w1", "w2", F.lit(0).cast("bigint").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    cuts = three.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(single("w1", "l1"), ["lang", "w1"]).join(single("w3", "r2"), ["lang", "w3"])
    cuts = cuts.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    cuts = cuts.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = alone.unionByName(cuts)
    for k in (1, 2, 3):
        scored = scored.join(words.select("lang", F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), ["lang", f"w{k}"], "left" if k == 3 else "inner")
    scored = scored.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top).drop("place", "salt")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM t, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT c.lang, c.k, c.phrase, c.a, array_to_string(w[1:x], ' ') AS lp, array_to_string(w[x + 1:], ' ') AS rp, x FROM c, (VALUES (1), (2)) v(x) WHERE x < c.k),
e AS (SELECT s.*, fl.a AS l, fr.a AS r, (1000000::HUGEINT * s.a * s.a) // (fl.a::HUGEINT * fr.a) AS score FROM s
      JOIN f fl ON fl.lang = s.lang AND fl.phrase = s.lp AND fl.k = s.x JOIN f fr ON fr.lang = s.lang AND fr.phrase = s.rp AND fr.k = s.k - s.x),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
i AS (SELECT lang, inner_phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM c WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n::BIGINT AS n, b.score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase AND b.k = 2
WHERE i.most IS NULL OR 100 * i.most < 50 * b.a QUALIFY rank <= 2000
"""
