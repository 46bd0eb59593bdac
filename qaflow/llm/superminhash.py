"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A signature has ``SLOTS`` values. Every shingle of a document draws a random permutation of the slots, one position after
the other, and offers slot number j of its permutation a value in [j, j + 1); a slot keeps the smallest offer. As the
offers of one shingle are ranks of one permutation, the slots are correlated in a way that lowers the variance below that
of independent min-hashes, and a document is done as soon as no slot's value can be beaten by the positions not yet
drawn: for n shingles after about ``SLOTS * ln(SLOTS) / n`` positions. All shingles of a batch draw a position at once.

``BANDS`` bands of ``SLOTS / BANDS`` values each give a document's buckets. Two documents of similarity 0.8 share none with a
probability below 5e-8. Equal sets are one *node* (known by the digest of one of their texts), however many rows have them.
Buckets name candidates, but never all pairs of a bucket:

1. every node is verified against one pivot of another component: of its buckets' pivots, the one that it shares most buckets
   with. A bucket's pivot is the node with most links so far, then the smallest ``doc_id``. The links go through union-find;
   this repeats while more than half of the trials link;
2. the pairs of nodes that share a bucket and are still in different components are verified, less those that a bitmap of
   parities of their shingles rules out (see ``jaccard_join.parities``; the bound is exact).

Verification compares the whole sets of 64-bit shingle hashes. Union-find runs in the tasks, over parts of the links, and
leaves a forest; the forests are joined by ``components``. Only counts reach the driver.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are their own component; fewer
words than ``width`` make one shingle; equal sets are linked; each row returns, and rows of one id are linked by their texts
only; ids of any orderable type; a null id is linked as any other by its text, returns the smallest id of its component (null if
there is none) and is kept only if that is null too; an empty table gives no rows; other columns, whatever their names,
are dropped (``near_duplicates``) or kept (``without_near_duplicates``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, saved
from .components import components
from .jaccard_join import LANES, mixed, overlap_links, parities, sets

WIDTH, NUM, DEN = 4, 4, 5  # words in a shingle; similarity of NUM / DEN
SLOTS, BANDS = 128, 32
STEP = 1 << 15  # shingles that draw at once: a permutation of SLOTS bytes each
FLUSH = 1 << 20  # links of a forest
BROADCAST_BYTES = 32 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def salt(k: int) -> np.uint64:
    """The number that is added to a shingle's hash for its k-th draw."""
    return np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def signatures(tokens: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """``n`` rows of ``slots`` values (position in the upper 8 bits, then 56 random bits) of the shingles' owners 0 to n-1.

    A shingle is left out of a round as soon as all slots of its owner hold values below that round's."""
    least = np.full((n, slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = least.reshape(-1)
    for at in range(0, len(tokens), STEP):
        t, o = tokens[at : at + STEP], owner[at : at + STEP]
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(t), 1))
        live = np.arange(len(t))
        for j in range(slots):
            # owners whose slots all have a value of an earlier position are done
            here = np.unique(o[live])
            open_ = np.zeros(n, bool)
            open_[here[least[here].max(1) >= np.uint64(j << 56)]] = True
            live = live[open_[o[live]]]
            if not len(live):
                break
            draw = mixed(t[live] + salt(2 * j + 1))
            k = j + (mixed(t[live] + salt(2 * j + 2)) % np.uint64(slots - j)).astype(np.int64)
            slot = order[live, k]
            order[live, k] = order[live, j]
            np.minimum.at(flat, o[live] * slots + slot, np.uint64(j << 56) | (draw >> np.uint64(8)))
    return least


def buckets(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit name for each band of each signature; equal only if the whole band is, but for collisions."""
    n, slots = signature.shape
    rows = signature.reshape(n, bands, slots // bands)
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)[None, :].repeat(n, 0)
    for k in range(rows.shape[2]):
        out = mixed(out * GOLDEN + rows[:, :, k])
    return out.view(np.int64)


class Forest:
    """Union-find over hashable nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]  # path halving
            x = up[x]
        return x

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# ------------------------------------------------------------------------------ Spark jobs


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def _described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, node, key, n`` of every row (``node`` is the text's digest, ``key`` the set's); ``buckets, bits`` where a set is first met in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (s for b in batches for s in byte_slices(b, "text")):
            own = sets(batch.column("text").to_pylist(), width)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
            # a set of fewer than NUM shingles is similar enough to equal sets only
            first = []
            for k, (key, s) in enumerate(zip(keys, own, strict=True)):
                if len(s) >= NUM and key not in seen:
                    seen.add(key)
                    first.append(k)
            if len(seen) > FLUSH:
                seen.clear()
            bits: list = [None] * len(own)
            bands: list = [None] * len(own)
            if first:
                tokens = np.concatenate([own[k] for k in first])
                owner = np.repeat(np.arange(len(first)), [len(own[k]) for k in first])
                for k, row in zip(first, buckets(signatures(tokens, owner, len(first))).tolist(), strict=True):
                    bands[k], bits[k] = row, parities(own[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array(bands, longs), pa.array(bits, longs)],
                names=["doc_id", "node", "key", "n", "buckets", "bits"],
            )

    rows = docs.select("doc_id", digest().alias("node"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, key binary, n bigint, buckets array<bigint>, bits array<bigint>")


def linked(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those rows ``a, b`` of ``pairs`` (digests of texts) whose whole sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if nodes.count() * 64 <= BROADCAST_BYTES:  # about the bytes of an entry of a hash table
        nodes = F.broadcast(nodes)
    texts = docs.select(digest().alias("node"), "text").join(nodes, "node", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (s for b in batches for s in byte_slices(b, "text")):
            names = batch.column("node").to_pylist()
            new = [k for k, x in enumerate(names) if not (x in seen or seen.add(x))]
            own = sets(batch.column("text").take(pa.array(new, pa.int64())).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in new], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "set"])
            if len(seen) > FLUSH:
                seen.clear()

    # written behind the aggregate, so that the joins with it have exchanges of their own, which a hot pivot's rows may be split over
    found = saved(texts.mapInArrow(make, "node binary, set binary").groupBy("node").agg(F.max("set").alias("set")), "verified-sets", compression="none")
    both = pairs.join(found.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(found.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return saved(both.select("a", "b", "set_a", "set_b").mapInArrow(test, "a binary, b binary"), "verified-links")


def forest(links: DataFrame) -> DataFrame:
    """Fewer links ``a, b`` of the same components: each task's links through union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()

        def edges() -> pa.RecordBatch:
            out = [(x, trees.root(x)) for x in list(trees.up)]
            out = [(x, r) for x, r in out if x != r]
            trees.up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([r for _, r in out], pa.binary())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                trees.link(a, b)
            if len(trees.up) > FLUSH:
                yield edges()
        yield edges()

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def _fit(n: str, n2: str) -> Column:
    """Sizes that two similar sets may have."""
    return F.least(n, n2) * DEN >= F.greatest(n, n2) * NUM


def _placed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``shared`` with ``comp``, for the buckets whose nodes are in two or more components."""
    named = shared.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    return named.join(apart, "bucket", "left_semi")


def _stars(placed: DataFrame, degree: DataFrame | None) -> DataFrame:
    """``a, b``: each node and the pivot of another component that it shares most buckets with."""
    ranked = placed.withColumn("deg", F.lit(0)) if degree is None else placed.join(degree, "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    # most links, then smallest id: as a minimum, so that ids of any type can be compared
    pivots = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("deg")).alias("d"), F.col("id").isNull().alias("unnamed"), "id", "node", "n", "comp")).alias("p"))
    tried = placed.join(pivots, "bucket").filter((F.col("comp") != F.col("p.comp")) & _fit("n", "p.n"))
    tried = tried.groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("p.unnamed", "p.id")).alias("first"))
    return tried.groupBy("a").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "b")).alias("m")).select("a", "m.b")


def _across(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes of different components that share a bucket, less those whose bitmaps differ in more places than two similar sets may."""
    left = placed.select("bucket", "node", "n", "comp").join(nodes.select("node", "bits"), "node")
    right = left.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("bits").alias("bits_b"))
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(1, LANES)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0])))
    # similar: difference * (DEN + NUM) <= (DEN - NUM) * (sum of the sizes)
    close = differ * (DEN + NUM) <= (F.col("n") + F.col("n_b")) * (DEN - NUM)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & (F.col("comp") < F.col("comp_b")) & _fit("n", "n_b") & close)
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def _groups(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, node, n, rep`` of every row; ``rep``: ``unnamed, id, node`` of smallest id in its component, null without shingles."""
    rows = saved(_described(docs, width), "superminhash")
    nodes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("node").alias("node"), F.max("n").alias("n"), F.min("doc_id").alias("id"), F.max("buckets").alias("buckets"), F.max("bits").alias("bits"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), "node")).alias("rep"),
    )
    nodes = saved(nodes, "distinct-sets")
    laid = nodes.select(F.explode("buckets").alias("bucket"), "node", "n", "id")
    held = laid.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    shared = saved(laid.join(held, "bucket", "left_semi"), "shared-buckets")
    placed, degree, edges, labels = shared.withColumn("comp", F.col("node")), None, None, None
    while True:
        trials = saved(_stars(placed, degree), "trials")
        links = linked(docs, trials, width)
        edges = links if edges is None else edges.unionByName(links)
        labels = components(forest(edges), "a", "b")
        placed = saved(_placed(shared, labels.withColumnRenamed("a", "node")), "placed-buckets")
        if links.count() * 2 <= trials.count():
            break
        degree = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    links = linked(docs, saved(_across(placed, nodes), "pairs-across"), width)
    labels = components(forest(edges.unionByName(links)), "a", "b")
    named = nodes.select("key", "node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("rep").alias("rep"))
    named = named.select("key", "component").join(firsts, "component").select("key", "rep")
    return rows.select("doc_id", "node", "key", "n").join(named, "key", "left").select("doc_id", "node", "n", "rep")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.id"))
    out = _groups(docs, width).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose text is that of the smallest id of its component (all rows of such an id and text), with all their columns."""
    gone = _groups(docs, width).filter(F.col("rep").isNotNull() & (~F.col("doc_id").eqNullSafe(F.col("rep.id")) | (F.col("node") != F.col("rep.node"))))
    # ids may be null, so the two are compared as one struct; columns of docs are never renamed
    bad = saved(gone.select("doc_id", "node").distinct(), "near-copies").alias("gone_rows")
    own = docs.alias("own_rows")
    same = F.col("own_rows.doc_id").eqNullSafe(F.col("gone_rows.doc_id")) & (F.unhex(F.md5(F.col("own_rows.text"))) == F.col("gone_rows.node"))
    return own.join(bad, same, "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT ra, rb FROM p JOIN n na ON na.r = ra JOIN n nb ON nb.r = rb WHERE 100 * c >= 80 * (na.n + nb.n - c)),
g AS (SELECT ra AS u, rb AS v FROM e UNION ALL SELECT rb, ra FROM e),
c AS (SELECT r AS u, r AS root FROM d UNION SELECT g.v, c.root FROM c JOIN g ON g.u = c.u),
o AS (SELECT d.r, d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
      FROM d LEFT JOIN n ON n.r = d.r JOIN c ON c.u = d.r JOIN d o ON o.r = c.root GROUP BY d.r, d.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
