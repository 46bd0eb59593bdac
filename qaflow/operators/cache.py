"""Semantic cache of answered questions.

Cache table: ``cache_id bigint, cvec array<float>, user_query string,
contexts array<context>, response string, ts timestamp_ntz``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..sources.versioned import VersionedTable, bucket
from .retrieve import CONTEXTS_TYPE
from .topk import _ROW_OVERHEAD, BLOCK_BYTES, GROUPS, Asked, _global_topk, asked_groups, grid, similarity_topk


PIVOTS = 32
# vectors that are dealt to cells at once, and bytes of the copies that are handed on at once
_DEALT_ROWS, _DEALT_BYTES = 1024, 2 << 20
# beyond this cosine distance a ball reaches most cells, so the plain grid is as good
WIDE = 0.3


def _units(v: pa.Array, pivots: np.ndarray):
    """The vectors that have a direction, of length 1, and their places in ``v``."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, pivots.shape[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = np.flatnonzero(np.isfinite(x).all(1))  # no direction, no cosine
    return x[at], at


def _away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, added in the order of the dimensions: the same for a vector whatever stands beside it, so that all passes agree on its bin."""
    out = np.zeros((len(x), len(pivots)))
    for d in range(pivots.shape[1]):
        out += (x[:, d, None] - pivots[None, :, d]) ** 2
    return np.sqrt(out)


def _bins(side: str, away: np.ndarray, radius: float):
    """Row, cell and ring: of the bin of each cached vector, of all bins that the ball of each question may meet."""
    if side == "p":
        row, cell = np.arange(len(away)), away.argmin(1) if len(away) else np.zeros(0, np.int64)
        return row, cell, np.floor(away[row, cell] / radius).astype(np.int64)
    # a vector within the radius of the question may be in cell j only if d(q, j) - d(q, nearest) <= 2 r, and is within r of d(q, j)
    row, cell = np.nonzero(away <= away.min(1, initial=np.inf)[:, None] + 2 * radius)
    low = np.maximum(np.floor((away[row, cell] - radius) / radius), 0).astype(np.int64)
    many = np.floor((away[row, cell] + radius) / radius).astype(np.int64) - low + 1
    begin = np.cumsum(many) - many
    ring = np.repeat(low - begin, many) + np.arange(int(many.sum()))
    return np.repeat(row, many), np.repeat(cell, many), ring


class _Packed:
    """Bins that hold cached vectors, in order, put together to blocks of at most ``block_bytes`` (a larger bin is a block of its own)."""

    def __init__(self, counts: list, dim: int, block_bytes: int) -> None:
        found = sorted((int(c["cell"]) << 40 | int(c["ring"]), c["n"]) for c in counts)
        self.code = np.array([c for c, _ in found], np.int64)
        self.n = [n for _, n in found]
        self.block, last, held = np.zeros(len(found), np.int64), 0, 0
        for i, n in enumerate(self.n):
            size = n * (dim * 8 + _ROW_OVERHEAD)
            if held and held + size > block_bytes:
                last, held = last + 1, 0
            self.block[i], held = last, held + size

    def met(self, row: np.ndarray, cell: np.ndarray, ring: np.ndarray):
        """The rows and numbers of those bins that hold cached vectors."""
        code = cell.astype(np.int64) << 40 | ring
        i = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        there = self.code[i] == code
        return row[there], i[there]

    def blocks(self, row: np.ndarray, i: np.ndarray):
        """Each row once for each block of its bins."""
        width = int(self.block[-1]) + 1
        both = np.unique(row * width + self.block[i])
        return both // width, both % width


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(lo, _DEALT_ROWS) for b in batches for lo in range(0, b.num_rows, _DEALT_ROWS))


def _counted(side: str, pivots: np.ndarray, radius: float, vec: str, packed: _Packed | None = None):
    """Arrow batches of vectors -> the number in each bin; with ``packed`` those of the bins by their numbers (``ring``, beside cell -1), and of the blocks (beside cell -2)."""

    def rows(cell, ring):
        found, n = np.unique(np.stack([cell, ring]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1].astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "ring", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _dealt(batches):
            row, cell, ring = _bins(side, _away(_units(batch.column(vec), pivots)[0], pivots), radius)
            if packed is None:
                yield rows(cell, ring)
                continue
            row, i = packed.met(row, cell, ring)
            block = packed.blocks(row, i)[1]
            yield rows(np.r_[np.full(len(i), -1), np.full(len(block), -2)], np.r_[i, block])

    return run


def _cells(side: str, pivots: np.ndarray, radius: float, key: str, vec: str, packed: _Packed | None = None):
    """Arrow batches of vectors with their cells of the pivot partition: one for a cached vector, all that its ball may meet for a question.
    With ``packed`` with their blocks of it instead, one copy for a block."""
    step = max(1, _DEALT_BYTES // (8 * pivots.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a question has a copy for each ring (or block) that its ball may meet, up to some hundred: they are made in small parts
        for batch in _dealt(batches):
            v = batch.column(vec)
            x, at = _units(v, pivots)
            row, cell, ring = _bins(side, _away(x, pivots), radius)
            if packed is not None:
                row, block = packed.blocks(*packed.met(row, cell, ring))
                group = {"block": block}
            else:
                group = {"cell": cell, "ring": ring}
            for lo in range(0, len(row), step):
                some = slice(lo, lo + step)
                take = pa.array(at[row[some]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(take), v.take(take), *[pa.array(c[some].astype(np.int32)) for c in group.values()], pa.array(np.full(len(take), pivots.shape[1], np.int32))],
                    names=[f"{side}_{'key' if side == 'q' else 'id'}", f"{side}_vec", *group, "dim"])

    return run


def _parts(pivots: np.ndarray, radius: float, packed: _Packed, whole: set):
    """For a cell of the grid, the rows of its points and questions that are scored with one another: those of each bin; all if the bins of a block leave out little."""

    def run(questions: pa.Table, P: np.ndarray, Q: np.ndarray) -> list:
        if questions.column("block")[0].as_py() in whole:
            return [(np.arange(len(P)), np.arange(len(Q)))]
        sides = []
        for side, x in (("p", P), ("q", Q)):
            row, i = (np.concatenate(c) for c in zip(*(_offset(packed.met(*_bins(side, _away(x[lo:lo + _DEALT_ROWS], pivots), radius)), lo) for lo in range(0, len(x), _DEALT_ROWS))))
            order = np.argsort(i, kind="stable")  # within a bin the rows stay in the order of their ids
            sides.append((row[order], i[order]))
        (points, p_bin), (asked, q_bin) = sides
        out = []
        for b in np.unique(p_bin):
            (p0, p1), (q0, q1) = np.searchsorted(p_bin, [b, b + 1]), np.searchsorted(q_bin, [b, b + 1])
            if q1 > q0:
                out.append((points[p0:p1], asked[q0:q1]))
        return out

    return run


def _offset(found, lo: int):
    return found[0] + lo, found[1]


def _pack(ask: DataFrame, cached: DataFrame, pivots: np.ndarray, radius: float, block_bytes: int, info: dict):
    """The blocks of bins, their sizes on both sides as :func:`topk.grid` takes them, and the blocks that are scored whole. None if the
    bins are too many to be known by the driver: they are then narrow, and a question meets few."""
    dim, out = pivots.shape[1], "cell int, ring long, n long"
    counts = cached.mapInArrow(_counted("p", pivots, radius, "cvec"), out).groupBy("cell", "ring").agg(F.sum("n").alias("n")).limit(GROUPS + 1).collect()
    if not 0 < len(counts) <= GROUPS:
        return None
    packed = _Packed(counts, dim, block_bytes)
    asked = ask.mapInArrow(_counted("q", pivots, radius, "qvec", packed), out).groupBy("cell", "ring").agg(F.sum("n").alias("n")).collect()  # a row for each bin and block
    nq = {r["ring"]: r["n"] for r in asked if r["cell"] == -2}
    met, held = dict.fromkeys(nq, 0), dict.fromkeys(nq, 0)
    for i, n in enumerate(packed.n):
        if packed.block[i] in nq:
            held[int(packed.block[i])] += n
    for r in asked:
        if r["cell"] == -1:
            met[int(packed.block[r["ring"]])] += r["n"] * packed.n[r["ring"]]
    whole = {b for b in nq if 2 * met[b] > nq[b] * held[b]}
    info["pairs"] = sum(nq[b] * held[b] if b in whole else met[b] for b in nq)
    spark = ask.sparkSession
    rows = [Row(block=b, dim=dim, nq=n) for b, n in sorted(nq.items())]
    asked_rows = Asked(F.broadcast(spark.createDataFrame(rows, "block int, dim int, nq long")), rows, True)
    sizes = spark.createDataFrame([(b, dim, n) for b, n in sorted(held.items())], "block int, dim int, np long")
    return packed, asked_rows, sizes, whole


def nearest_within(questions: DataFrame, cache: DataFrame, tolerance: float, key: str = "event_id",
                   block_bytes: int = BLOCK_BYTES, info: dict | None = None) -> DataFrame | None:
    """C4: the nearest cache entry of a question by cosine, exact for entries within ``tolerance``: ``(key, rank, cache_id, score)``.

    On unit vectors a cosine distance of t is a Euclidean one of sqrt(2 t), a metric. Cached vectors are dealt to the nearest
    of ``PIVOTS`` pivots (cache entries, chosen by hash) and to rings of the ball's radius around it; by the triangle inequality
    a question meets three rings of the cells that its ball can reach, and no others. These bins are counted and put together to
    blocks of ``block_bytes``, so a question is copied once for each block that it may meet, not for each bin: never more often than
    in the plain grid. The blocks are searched as the groups of :func:`topk.grid`, which cuts a bin that holds most of the cache like
    any other group; within a block only the bins that a question meets are scored, unless that spares less than half.
    ``info["pruned"]``: the share of all pairs that is never scored (two further counts). None if the cache is empty."""
    counting, info = info is not None, info if info is not None else {}
    cached = cache.where(F.size("cvec") > 0).select("cache_id", "cvec")
    sample = cached.orderBy(F.xxhash64("cache_id", F.lit(7)), "cache_id").limit(PIVOTS).collect()  # PIVOTS rows
    if not sample:
        return None
    dim = len(sample[0]["cvec"])
    pivots = np.array([r["cvec"] for r in sample if len(r["cvec"]) == dim and None not in r["cvec"]], np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = pivots[np.isfinite(pivots).all(1)]
    if not len(pivots):
        return similarity_topk(questions, cache, 1, key=key, point_id="cache_id", vector="cvec", metric="cosine", block_bytes=block_bytes, info=info)
    radius = (2 * max(tolerance, 0.0)) ** 0.5 + 1e-6
    key_type, id_type = questions.schema[key].dataType, cache.schema["cache_id"].dataType
    ask, held = questions.where(F.size("qvec") == dim).select(key, "qvec"), cached.where(F.size("cvec") == dim)
    packed, asked, sizes, whole = _pack(ask, held, pivots, radius, block_bytes, info) or (None, None, None, None)
    group = ["cell", "ring", "dim"] if packed is None else ["block", "dim"]
    columns = ", ".join(f"{c} int" for c in group)
    q = ask.mapInArrow(_cells("q", pivots, radius, key, "qvec", packed), f"q_key {key_type.simpleString()}, q_vec {questions.schema['qvec'].dataType.simpleString()}, {columns}")
    p = held.mapInArrow(_cells("p", pivots, radius, "cache_id", "cvec", packed), f"p_id {id_type.simpleString()}, p_vec {cache.schema['cvec'].dataType.simpleString()}, {columns}")
    scored = info.get("pairs")
    if packed is None:
        best = grid(q, p, group, asked_groups(q, group), 1, None, "cosine", (key, key_type), ("cache_id", id_type), block_bytes, info)
    else:
        best = grid(q, p, group, asked, 1, None, "cosine", (key, key_type), ("cache_id", id_type), block_bytes, info, sizes, _parts(pivots, radius, packed, whole))
        info["pairs"] = scored
    if counting and "pairs" in info:
        every = ask.count() * cached.count()
        info["pruned"] = 1 - info["pairs"] / every if every else 0.0
    return None if best is None else _global_topk(best, key, "cache_id", 1, 0)


def cache_lookup(questions: DataFrame, cache: DataFrame, cfg, key: str = "event_id", info: dict | None = None) -> DataFrame:
    """Nearest cache entry per question by cosine distance; hits within tolerance only.

    Returns ``(key, cache_id, distance, contexts, response)``.
    """
    if cfg.metric == "cosine" and cfg.match_tolerance <= WIDE:
        best = nearest_within(questions, cache, cfg.match_tolerance, key, info=info)
    else:
        best = similarity_topk(questions, cache, 1, key=key, point_id="cache_id", vector="cvec", metric=cfg.metric, info=info)
    if best is None:
        best = questions.sparkSession.createDataFrame([], T.StructType([questions.schema[key], cache.schema["cache_id"], T.StructField("score", T.DoubleType())]))
    dist = (F.lit(1.0) - F.col("score")) if cfg.metric == "cosine" else -F.col("score")
    hits = best.withColumn("distance", dist).where(F.col("distance") <= F.lit(cfg.match_tolerance))
    return hits.join(cache.select("cache_id", "contexts", "response"), "cache_id", "inner") \
        .select(key, "cache_id", "distance", "contexts", "response")


def cache_misses(questions: DataFrame, hits: DataFrame) -> DataFrame:
    return questions.join(hits.select("event_id"), "event_id", "left_anti")


def cache_entries(state: DataFrame, ts_col=None) -> DataFrame:
    """Answered, non-fallback, non-hit rows of a pipeline state as cache entries."""
    bad = F.exists("errors", lambda e: e["stage"].isin(K.RETRIEVE, K.GENERATE))
    ts = ts_col if ts_col is not None else F.localtimestamp()
    return state.where(F.col("response").isNotNull() & ~bad & ~F.col("cache_hit") & F.col("qvec").isNotNull()) \
        .select(F.xxhash64("event_id").alias("cache_id"), F.col("qvec").alias("cvec"), "user_query",
                "contexts", "response", ts.alias("ts"))


def cache_write(cache: DataFrame, entries: DataFrame, size: int | None = None) -> DataFrame:
    """Append entries not yet cached; with ``size`` keep the newest ``size`` entries.

    The size cut is a distributed top-N (``TakeOrderedAndProject``), bounded by ``size``.
    """
    from ..sources.articles import last_per_key

    new = last_per_key(entries, "cache_id", "ts").select(*entries.columns) \
        .join(cache.select("cache_id"), "cache_id", "left_anti")
    out = cache.unionByName(new)
    return out if size is None else newest(out, size)


def newest(cache: DataFrame, size: int) -> DataFrame:
    return cache.orderBy(F.col("ts").desc(), F.col("cache_id").asc()).limit(int(size))


class CacheStore(VersionedTable):
    """The cache as a versioned table; what one batch writes, the next one reads."""

    def __init__(self, spark: SparkSession, root: str, dim_type: T.DataType | None = None, buckets: int = 16) -> None:
        schema = T.StructType([
            T.StructField("cache_id", T.LongType()), T.StructField("cvec", T.ArrayType(dim_type or T.FloatType())),
            T.StructField("user_query", T.StringType()), T.StructField("contexts", CONTEXTS_TYPE),
            T.StructField("response", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
        super().__init__(spark, root, schema, "cache_id", [bucket(buckets)])

    def keep(self, entries: DataFrame, size: int | None = None, batch: str | None = None) -> int:
        """Add the entries whose id is not there; with ``size`` the oldest ones beyond it go."""
        new = cache_write(self.read().limit(0), entries).join(self.read().select("cache_id"), "cache_id", "left_anti")
        version = self.patch(new.select(*self.schema.fieldNames()), F.lit(False), batch=batch)
        if size is not None:
            now = self.read()
            gone = now.select("cache_id").join(newest(now, size).select("cache_id"), "cache_id", "left_anti")
            if not gone.isEmpty():
                version = self.delete(gone)
        return version
