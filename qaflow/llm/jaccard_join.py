"""N-gram Jaccard self-join with token-combination prefixes.

The tokens of a document are its distinct 5-word shingles (64-bit hashes). All tokens have one global
order: estimated frequency, from a count sketch of fixed size over all documents, then hash. Tokens of low
estimate are *rare*, the others *frequent*. Frequent tokens fall into classes by hash; the number of classes
follows the size level of the document, so that a prefix holds a few tokens of each. A document's prefix grows
until killing all its signatures takes more tokens than a linked partner may lack: a rare token counts one, a
frequent token one beyond the first of its class. Signatures are single rare tokens and pairs of frequent tokens
of one class. Two linked documents share a signature at the level of the larger one, which the smaller one
emits too.

Shared signatures give candidates, but never all their pairs:
 1. every document is verified against one pivot of another component that it shares most signatures with, the pivot
    of a signature being its document with most links so far; this repeats while more than half find a link;
 2. among signatures whose documents are still in different components, the pairs across components are verified, less
    those that a bitmap rules out: each document has the parities of its tokens in ``64 * LANES`` buckets, a token that
    one set has and the other lacks flips one parity, so the parities that differ bound the size of the difference.
A pair that shares a frequent signature has all its rare tokens in both prefixes: those that no other document emits are
missing in the other set, which bounds the overlap and spares most verifications among copies that are too far apart.
Pairs within a component cannot change it, so the components are exact.
Verification compares the sorted shingle hashes. The only approximation is a collision of 64-bit hashes within
one compared pair (about 1e-13) or of the 128-bit key by which equal sets are collapsed. The join knows a row by a 64-bit
hash of id and text (*node*); hashes that different rows share are found beforehand by a second, independent hash, and
those rows are known by that one, so that rows are mistaken for each other only if both hashes agree.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing (component: their own id);
fewer than five words make one shingle; equal sets are linked; each row returns, rows of one id are linked by their
texts only; a row whose id is null is linked as any other by its text and returns the smallest id of its component
(null if there is none); empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, saved, small_batches
from .components import components

WIDTH, NUM, DEN = 5, 4, 5  # words in a shingle; similarity of NUM / DEN
SKETCH_BITS, SLICE = 20, 1 << 14
SKETCH_TASKS, SKETCH_FAN = 1 << 14, 64
RARE, CLASS_TOKENS = 64, 4
FLUSH = 1 << 22
LANES = 16  # longs of a bitmap
ODD = np.uint64(1)
BROADCAST_BYTES = 64 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; wraps around on purpose."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, one text after the other with repeats, and where each text ends."""
    words = [(t or "").encode().lower().split() for t in texts]  # bytes: A-Z only, ASCII white space only
    n = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [x for w in words for x in w]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    begin = np.cumsum(n) - n
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    # the start of each shingle; short texts use up to all their words
    end = np.cumsum(size)
    at = np.repeat(begin - (end - size), size) + np.arange(int(size.sum()))
    length = np.repeat(np.minimum(n, width), size)
    out = mixed(length.astype(np.uint64) + np.uint64(width))
    for k in range(width):
        has = length > k
        word = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        out = np.where(has, mixed(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return out, end


def sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    h, end = shingles(texts, width)
    return [np.unique(x) for x in np.split(h, end[:-1])] if len(end) else []


def parities(tokens: np.ndarray) -> list[int]:
    """Parity of the number of tokens in each of ``64 * LANES`` buckets, as longs."""
    odd = np.bincount((mixed(tokens) % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def overlap_links(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def signatures(tokens: np.ndarray, sketch: np.ndarray, frequent: int) -> np.ndarray:
    """Distinct signatures of one set (see the module's text): even for single tokens, odd for pairs."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]  # one token: only equal sets are similar enough
    estimate = sketch[(tokens & np.uint64(len(sketch) - 1)).astype(np.int64)]
    order = np.lexsort((tokens, estimate))
    tokens, often = tokens[order], estimate[order] > frequent
    lack = n - -(-NUM * n // DEN)
    if not often[: lack + 1].any():
        return tokens[: lack + 1] & ~ODD
    out = []
    for level in {n.bit_length(), (DEN * n // NUM).bit_length()}:
        classes = max(1, round((1 << (level - 1)) * (DEN - NUM) / DEN / CLASS_TOKENS))
        cls = np.where(often, (mixed(tokens) % np.uint64(classes)).astype(np.int64), -1)
        first = np.zeros(n, bool)
        first[np.unique(cls, return_index=True)[1]] = True
        worth = np.cumsum(~often | ~first)
        stop = int(np.searchsorted(worth, lack + 1)) + 1
        out.append(tokens[:stop][~often[:stop]] & ~ODD)
        t, c = tokens[:stop][often[:stop]], cls[:stop][often[:stop]]
        by = np.lexsort((t, c))
        t, c = t[by], c[by]
        for lag in range(1, int(np.bincount(c).max()) if len(c) else 1):
            same = c[lag:] == c[:-lag]
            out.append(mixed(t[:-lag][same] * np.uint64(0x9E3779B97F4A7C15) + mixed(t[lag:][same] + np.uint64(level))) | ODD)
    return np.unique(np.concatenate(out))


# ------------------------------------------------------------------------------ Spark jobs


def row_hash(seed: int):
    """Of id and text, null or not: equal for rows of equal id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), "text")


def with_nodes(docs: DataFrame, name: str, shared: DataFrame | None) -> DataFrame:
    """``docs`` with ``name``, what the join knows a row by: its first hash, or its second where the first is one of ``shared``."""
    if shared is None:
        return docs.withColumn(name, row_hash(0))
    (other,) = free([*docs.columns, name], "other")
    both = docs.withColumn(name, row_hash(0)).join(shared.withColumnRenamed("hash", name).withColumn(other, F.lit(True)), name, "left")
    return both.withColumn(name, F.when(F.col(other), row_hash(1)).otherwise(F.col(name))).drop(other)


def shared_hashes(docs: DataFrame) -> DataFrame | None:
    """``hash``: first hashes that stand for rows of different id or text (some 300 expected in 10^11 rows); None without any.

    The table is read back, so that the planner knows its size and takes the join on it for a broadcast only if it is small."""
    both = docs.select(row_hash(0).alias("hash"), row_hash(1).alias("other")).groupBy("hash").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    found = saved(both.filter("lo <> hi").select("hash"), "shared-hashes")
    return None if found.isEmpty() else found


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of all shingles by their low ``SKETCH_BITS`` bits; 4 MB however large the corpus.

    Every scan task puts out 4 MB, so these tasks are limited in number (each reads more, in batches) and their slices
    are added up in two steps: no task reads more than ``SKETCH_TASKS / SKETCH_FAN`` slices of 64 KB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            h, _ = shingles(batch.column("text").to_pylist(), width)
            total += np.bincount((h & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
        if total.any():
            parts = total.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([np.minimum(p, 0xFFFFFFFF).astype("<u4").tobytes() for p in parts], pa.binary())], names=["k", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes() for c in total.values()], pa.binary())], names=["k", "c"])

    counted = docs.select("text").coalesce(SKETCH_TASKS).mapInArrow(count, "k int, c binary").withColumn("part", F.spark_partition_id() % SKETCH_FAN)
    some = counted.repartition("k", "part").select("k", "c").mapInArrow(add, "k int, c binary")
    sums = some.repartition("k").mapInArrow(add, "k int, c binary")
    out = np.zeros((1 << SKETCH_BITS) // SLICE * SLICE, np.uint32).reshape(-1, SLICE)
    for k, c in sums.collect():  # of fixed size
        out[k] = np.frombuffer(c, "<u4")
    return out.reshape(-1)


def _described(rows: DataFrame, sketch, frequent: int, width: int) -> DataFrame:
    """``node, doc_id, key, n`` of every document (``sig`` null), and, for each signature of a task, its smallest node with the others as ``members``."""

    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("rare", pa.int32()), ("bits", pa.list_(pa.int64())), ("sig", pa.int64()), ("members", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        held: list[tuple[int, int, np.ndarray]] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            sig = np.concatenate([s for _, _, s in held]).view(np.int64)
            doc = np.repeat([d for d, _, _ in held], [len(s) for _, _, s in held])
            size = np.repeat([n for _, n, _ in held], [len(s) for _, _, s in held])
            order = np.lexsort((doc, sig))
            sig, doc, size = sig[order], doc[order], size[order]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            stop = np.append(first[1:], len(sig))
            rest = np.ones(len(sig), bool)
            rest[first] = False
            ends = np.concatenate([[0], np.cumsum(stop - first - 1)]).astype(np.int32)
            held.clear(), seen.clear()
            none = pa.nulls(len(first), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[first], pa.int64()), pa.nulls(len(first), pa.int64()), pa.array(size[first], pa.int32()), none, pa.nulls(len(first), pa.int32()), pa.nulls(len(first), schema.field("bits").type), pa.array(sig[first], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[rest], pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(size[rest], pa.int32()))],
                schema=schema,
            )

        total = 0
        for batch in batches:
            nodes, ids = batch.column("node"), batch.column("doc_id")
            all_sets = sets(batch.column("text").to_pylist(), width)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in all_sets]
            n, rare, bits = len(ids), [], []
            for d, k, s in zip(nodes.to_pylist(), keys, all_sets, strict=True):
                own = None
                if k is not None and k not in seen:
                    seen.add(k)
                    sigs = signatures(s, counts, frequent)
                    if len(sigs):  # one token has none: only equal sets, found by their key, are linked with it
                        held.append((d, len(s), sigs))
                    total += len(sigs)
                    pairs = int((sigs & ODD).sum())
                    own = len(sigs) - pairs if pairs else 0
                rare.append(own)
                bits.append(None if own is None else parities(s))
            yield pa.RecordBatch.from_arrays(
                [nodes, ids, pa.array([len(s) for s in all_sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(rare, pa.int32()),
                 pa.array(bits, schema.field("bits").type), pa.nulls(n, pa.int64()), pa.nulls(n, schema.field("members").type), pa.nulls(n, schema.field("sizes").type)], schema=schema)
            if total >= FLUSH:
                yield flush()
                total = 0
        if held:
            yield flush()

    return rows.mapInArrow(
        run, "node bigint, doc_id bigint, n int, key binary, rare int, bits array<bigint>, sig bigint, members array<bigint>, sizes array<int>"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and document: a row for each document of a signature that two or more have."""
    sig = first = None  # of the run, and its first row while it is alone
    for batch in batches:
        out: list[tuple] = []
        for s, d, n, members, sizes in zip(*(batch.column(c).to_pylist() for c in ("sig", "node", "n", "members", "sizes")), strict=True):
            if s != sig:
                sig, first = s, (s, d, n)
            elif first:
                out.append(first)
                first = None
            if not first:
                out.append((s, d, n))
            if members and first:
                out.append(first)
                first = None
            out += [(s, m, k) for m, k in zip(members, sizes, strict=True)]
        if out:
            cols = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["sig", "doc", "n"])


def _possible(n: str, most: str, n2: str, most2: str):
    """Two sets of these sizes can be similar enough if they share no more than ``most`` and ``most2`` tokens."""
    shared = F.least(n, n2, F.when(F.col("sig") % 2 == 0, F.col(n)).otherwise(F.least(most, most2)))
    return shared * DEN >= (F.col(n) + F.col(n2) - shared) * NUM


def _across(apart: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: documents of different components that share a signature, less those whose bitmaps differ in more places than two similar sets may.

    The bitmaps are compared in the condition of the join: pairs that they rule out never become rows."""
    bits = rows.filter("rare IS NOT NULL").select(F.col("node").alias("doc"), "bits").dropDuplicates(["doc", "bits"])
    left = apart.join(bits, "doc")
    right = left.select(F.col("sig").alias("sig_b"), F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("comp").alias("comp_b"), F.col("bits").alias("bits_b"))
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(1, LANES)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0])))
    # similar: difference * (DEN + NUM) <= (DEN - NUM) * (sum of the sizes)
    close = differ * (DEN + NUM) <= (F.col("n") + F.col("n_b")) * (DEN - NUM)
    pairs = left.join(right, (F.col("sig") == F.col("sig_b")) & (F.col("comp") < F.col("comp_b")) & _possible("n", "most", "n_b", "most_b") & close)
    return pairs.select(F.col("doc").alias("a"), "b").distinct()


def verified(rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those rows ``a, b`` of ``pairs`` whose documents are similar enough; ``rows`` holds ``node`` and ``text``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if nodes.count() * 64 <= BROADCAST_BYTES:  # about the bytes of an entry of a hash table
        nodes = F.broadcast(nodes)
    texts = rows.select("node", "text").join(nodes, "node", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s.tobytes() for s in sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(got, pa.binary())], names=["node", "set"])

    kept = saved(texts.mapInArrow(make, "node bigint, set binary"), "shingle-sets", compression="none").groupBy("node").agg(F.collect_set("set").alias("sets"))
    both = pairs.join(kept.select(F.col("node").alias("b"), F.col("sets").alias("set_b")), "b").join(kept.select(F.col("node").alias("a"), F.col("sets").alias("set_a")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [any(overlap_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x in xs for y in ys)
                  for xs, ys in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return saved(both.select("a", "b", "set_a", "set_b").mapInArrow(test, "a bigint, b bigint"), "jaccard-links")


def _apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``shared`` with ``comp``, for the signatures whose documents are in two or more components."""
    placed = shared.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    mixed_sigs = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    return placed.join(mixed_sigs, "sig", "left_semi")


def _stars(apart: DataFrame, degree: DataFrame | None) -> DataFrame:
    """``a, b``: each document and the pivot of another component that it shares most signatures with.

    The pivot of a signature is its document with most links so far, the smallest id among equals: an original mostly comes before its copies."""
    placed = apart.withColumn("deg", F.lit(0)) if degree is None else apart.join(degree, "doc", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    pivots = placed.groupBy("sig").agg(F.max(F.struct("deg", F.bitwise_not("id").alias("first"), F.bitwise_not("doc").alias("minus"), "n", "most", "comp")).alias("p"))
    tried = apart.join(pivots, "sig").filter(F.col("comp") != F.col("p.comp")).filter(_possible("n", "most", "p.n", "p.most"))
    tried = tried.groupBy(F.col("doc").alias("a"), F.bitwise_not("p.minus").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("p.first").alias("first"))
    best = tried.groupBy("a").agg(F.max(F.struct("c", "first", F.bitwise_not("b").alias("minus"))).alias("m"))
    return best.select("a", F.bitwise_not("m.minus").alias("b"))


def _groups(docs: DataFrame, width: int, shared_by: DataFrame | None) -> DataFrame:
    """``node, doc_id, n, rep`` for every row of ``docs``; ``rep`` is the ``doc_id, node`` of smallest id in its component, null without shingles."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 500)
    counts = frequency_sketch(docs, width)
    frequent = RARE + 2 * int(counts.mean())
    sketch = spark.sparkContext.broadcast(counts)
    noded = with_nodes(docs.select("doc_id", "text"), "node", shared_by).select("node", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = saved(_described(noded, sketch, frequent, width).withColumn("kind", F.when(F.col("sig").isNull(), 0).otherwise(1)), "shingle-signatures")
    rows = described.filter("kind = 0").select("node", "doc_id", "n", "key", "rare", "bits")
    sigs = described.filter("kind = 1").select("sig", "node", "n", "members", "sizes")
    shared = sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_runs, "sig bigint, doc bigint, n int")
    shared = saved(shared, "shared-signatures")
    # signatures of single tokens less those that another document has too: tokens that no other holder of pairs shares
    common = shared.groupBy("doc").agg(F.count(F.when(F.col("sig") % 2 == 0, 1)).alias("common"))
    own = rows.filter("rare IS NOT NULL").groupBy(F.col("node").alias("doc")).agg(F.min("rare").alias("rare"), F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("id"))
    most = common.join(own, "doc").select("doc", "id", F.greatest(F.lit(0), F.col("rare") - F.col("common")).alias("lone"))
    shared = saved(shared.join(most, "doc").withColumn("most", F.col("n") - F.col("lone")).select("sig", "doc", "n", "most", "id"), "shared-sized")
    # equal sets: the holders of one key, a task each
    holders = rows.filter("rare IS NOT NULL").select(F.col("node").alias("a"), "key")
    firsts = holders.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("last")).filter("b <> last").select("key", "b")
    edges = holders.join(firsts, "key").filter("a <> b").select("a", "b")
    # stars, repeated while most of them hold
    apart, degree = shared.withColumn("comp", F.col("doc")), None
    while True:
        best = saved(_stars(apart, degree), "stars")
        links = verified(noded, best, width)
        edges = saved(edges.unionByName(links), "edges")
        labels = components(edges, "a", "b")
        apart = saved(_apart(shared, labels), "apart")
        if links.count() * 2 <= best.count():
            break
        degree = edges.groupBy(F.col("b").alias("doc")).agg(F.count(F.lit(1)).alias("deg"))
    # the pairs across components that share a signature
    links = verified(noded, saved(_across(apart, rows), "across"), width)
    labels = components(edges.unionByName(links), "a", "b").select(F.col("node").alias("a"), "component")
    # from holders to keys; a component is named by the smallest id of any of its rows
    placed = holders.join(labels, "a", "left").groupBy("key").agg(F.min(F.coalesce("component", "a")).alias("label"))
    reps = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("rep"))
    named = reps.join(placed, "key")
    names = named.groupBy("label").agg(F.min("rep").alias("rep"))
    named = named.select("key", "label").join(names, "label").select("key", "rep")
    return rows.select("node", "doc_id", "n", "key").join(named, "key", "left").select("node", "doc_id", "n", "rep")


def similar_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    return _groups(docs, width, shared_hashes(docs)).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id (if all ids are null, one of these).

    Rows without shingles are linked with nothing and stay, save repeats of one id and text."""
    shared = shared_hashes(docs)
    rows = saved(_groups(docs, width, shared).select("node", "doc_id", F.col("rep.node").alias("rep")), "grouped-rows")
    gone = rows.filter("node <> rep").select("node").distinct()
    repeated = rows.filter("node = rep OR rep IS NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("node")
    (own,) = free(docs.columns, "node")
    left = with_nodes(docs, own, shared).join(gone.withColumnRenamed("node", own), own, "left_anti")
    repeated = repeated.withColumnRenamed("node", own)
    once = left.join(repeated, own, "left_semi").dropDuplicates([own])
    return left.join(repeated, own, "left_anti").unionByName(once).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT ra, rb FROM p JOIN n na ON na.r = ra JOIN n nb ON nb.r = rb WHERE 100 * c >= 80 * (na.n + nb.n - c)),
g AS (SELECT ra AS u, rb AS v FROM e UNION ALL SELECT rb, ra FROM e),
c AS (SELECT r AS u, r AS root FROM d UNION SELECT g.v, c.root FROM c JOIN g ON g.u = c.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN c ON c.u = d.r JOIN d o ON o.r = c.root GROUP BY d.r, d.doc_id
"""
