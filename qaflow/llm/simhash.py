"""SimHash fingerprints and permuted block tables (DataFrame functions only).

Terms are the 5-word shingles of a text (words: lower case, cut at white space; a text of fewer words is one
shingle). Each occurrence of a term votes, so a term weighs its frequency: bit ``j`` of the fingerprint is 1 if more
than half of the votes have it. Votes are counted in two 32-bit lanes of a long, 32 sums for 64 bits, inside
generated code next to the scan, so only one row a text is shuffled.

:func:`near` cuts fingerprints into ``radius + 2`` blocks. Two fingerprints within the radius agree in two blocks at
least, so the tables keyed by every pair of blocks find all of them; equal fingerprints are one entry with a count.

Defined cases: a null text is an empty one; a text without words has fingerprint 0; equal texts have equal
fingerprints; documents are ordered by ``doc_id`` (null first), then by a hash of the text; repeated rows are one
document in that order and each returns; the next document of the last, and of a single one, is the first; empty
tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import or_empty, saved

WIDTH, BITS, RADIUS = 5, 64, 3
LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (long). The keys must tell the rows apart."""
    w = texts.select(*keys, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\s+", " ")), " ").alias("w"))
    n = F.when(F.col("w")[0] != "", F.greatest(F.lit(0), F.size("w") - WIDTH))
    at = w.select(*keys, "w", F.explode_outer(F.when(n.isNotNull(), F.sequence(F.lit(0), n))).alias("at"))
    h = at.select(*keys, F.when(F.col("at").isNotNull(), F.xxhash64(*[F.get("w", F.col("at") + k) for k in range(WIDTH)])).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES))).alias(f"v{j}") for j in range(BITS // 2)]
    sums = h.groupBy(*keys).agg(F.count("h").alias("m"), *votes)
    bits = []
    for j in range(BITS // 2):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{j}", 32)
        bits += [F.when(low * 2 > F.col("m"), F.lit(1 << j)).otherwise(F.lit(0))]
        top = 1 << (j + 32)
        bits += [F.when(high * 2 > F.col("m"), F.lit(top - (1 << 64) if top >> 63 else top).cast("bigint")).otherwise(F.lit(0).cast("bigint"))]
    fp = bits[0].cast("bigint")
    for b in bits[1:]:
        fp = fp.bitwiseOR(b.cast("bigint"))
    return sums.select(*keys, F.coalesce(fp, F.lit(0).cast("bigint")).alias("fp"))


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, found``: for each distinct ``fp`` of ``queries``, how many rows of ``index`` lie within ``radius`` (itself included)."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    pairs = list(combinations(range(n), 2))

    def tables(df: DataFrame) -> DataFrame:
        block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        keys = [F.struct(F.lit(t).alias("t"), block[i].alias("x"), block[j].alias("y")) for t, (i, j) in enumerate(pairs)]
        return df.select("*", F.explode(F.array(*keys)).alias("key"))

    held = tables(index.groupBy("fp").agg(F.count(F.lit(1)).alias("c")))
    asked = tables(queries.select("fp").distinct()).withColumnRenamed("fp", "q")
    found = asked.join(held, "key").filter(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius)
    return found.select("q", "fp", "c").distinct().groupBy(F.col("q").alias("fp")).agg(F.sum("c").alias("found"))


def following(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_chars, next_id, next_th``: each distinct document and the one after it, the first after the last.

    Rows are range-partitioned; a window runs inside each range, and one row a range bridges to the next."""
    keys = docs.select("doc_id", F.xxhash64(or_empty()).alias("th"), F.length(or_empty()).cast("bigint").alias("n_chars")).distinct()
    ranged = saved(keys.repartitionByRange("doc_id", "th").withColumn("part", F.spark_partition_id()), "document-order")
    me = F.struct("doc_id", "th")
    inner = Window.partitionBy("part").orderBy("doc_id", "th")
    heads = ranged.groupBy("part").agg(F.min(me).alias("head"))
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).alias("head"))
    out = ranged.withColumn("next", F.lead(me).over(inner)).join(F.broadcast(heads), "part")  # one row for each range
    out = out.withColumn("next", F.coalesce("next", "head"))
    return out.select("doc_id", "th", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, th, n_chars, text, edited, next_id, next_th``: the last half of each text replaced by the start of the next one's."""
    order = saved(following(docs), "next-document")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(or_empty()).alias("h"), or_empty().alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    start = order.join(texts, order["next_id"].eqNullSafe(texts["id"]) & (order["next_th"] == texts["h"]))
    start = start.select(F.col("doc_id"), "th", "n_chars", "next_id", "next_th", F.substring("text", F.lit(1), half).alias("start")).dropDuplicates(["doc_id", "th"])
    both = texts.join(start, texts["id"].eqNullSafe(start["doc_id"]) & (texts["h"] == start["th"]))
    new = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.col("start"))
    return both.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "th", "n_chars", "text", new.alias("edited"), "next_id", "next_th")


def compare(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Fingerprints of all texts and edited texts, their likeness, and the search: ``n_near``, for documents whose id is
    divisible by ``every``, counts the other rows within ``radius``."""
    keys = ["rid", "doc_id", "th", "n_chars", "sha", "next_id", "next_th"]
    e = edited(docs).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    two = e.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    fps = saved(fingerprints(two.select(*keys, F.col("x.v").alias("v"), F.col("x.t").alias("text")), [*keys, "v"]), "fingerprints")
    own = fps.filter("v = 0")
    new = fps.filter("v = 1").select("rid", F.col("fp").alias("edited_fp"))
    nexts = own.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), F.col("fp").alias("next_fp")).distinct()
    out = own.join(new, "rid")
    out = out.join(nexts, out["next_id"].eqNullSafe(nexts["id"]) & (out["next_th"] == nexts["h"]))
    found = near(own.filter(F.col("doc_id") % every == 0), own, radius)
    out = out.join(found, "fp", "left")
    n_near = F.when(F.col("doc_id") % every == 0, F.col("found") - 1)
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), n_near.alias("n_near"),
    )
