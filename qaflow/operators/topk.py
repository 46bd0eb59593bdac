"""Exact top-k similarity join as a grid of blocks.

Neither side passes through the driver and no pair becomes a row:

1. *Groups.* A question meets only the points of its *group*: the same vector size and, if it carries metadata
   filters, the same values of the filtered keys. A point is laid out once for each set of keys that questions
   filter on (mostly one), so the filter is an equality of the shuffle key, not a mask after the product.
2. *Blocks.* The two sides of a group are counted. Each side is cut by hash into blocks of at most ``block_bytes``;
   a large group (one value may hold a third of all rows) thus becomes a grid of cells, a small one is one cell.
   Questions are copied to the cells of their row, points to those of their column.
3. *Cells.* A cogroup on (group, row, column) brings the two blocks of a cell together in a task, which multiplies
   them and keeps the ``k`` best of each question.
4. ``row_number`` over the cells of a question (with a partial ``WindowGroupLimit``) leaves the global top-k.

The shuffle carries ``2 * questions * points / block`` vectors besides one copy of each side, whatever the skew; only
counts of groups reach the driver (at most ``GROUPS`` rows; beyond that they stay a table and are joined).

Scores are exact dot products (or cosine) in float64, summed in the order of the dimensions. Ties are cut by point id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import filters as FL

METRICS = ("dot", "cosine")
BLOCK_BYTES = 8 << 20
# groups whose counts are read by the driver
GROUPS = 10_000
# values of a filtered key that are pushed into the collection's scan
_PUSHED = 1000
# rows x questions score cells held at once by one task (float64); what is made of them takes a few times as much
_CELL_BUDGET = 1 << 20
_ROW_OVERHEAD = 64
_GROUP = ["keys", "vals", "dim"]


# ----------------------------------------------------------------------------- numpy kernels

def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows; a null entry is NaN and gives no score."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks], type=column.type.value_type)
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / n


def _select_topk(q: np.ndarray, ids: np.ndarray, s: np.ndarray, kk: int):
    """Keep the best ``kk`` (score desc, id asc) per question index ``q``."""
    if len(q) == 0:
        return q, ids, s, np.zeros(0, dtype=np.int64)
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    pos = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = pos < kk
    return q[keep], ids[keep], s[keep], pos[keep]


_PROBE_ROWS = 1024


def _slack(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """Per question: how far two sums of the same products in another order can lie apart.

    A matrix product adds in an order that depends on its shape. Sums of small integers are exact in any order."""
    if not P.size or not Q.size:
        return np.zeros(len(Q))
    top = np.abs(P).max() * np.abs(Q).max() * P.shape[1]
    if top < 2.0 ** 53 and (P == np.rint(P)).all() and (Q == np.rint(Q)).all():
        return np.zeros(len(Q))
    with np.errstate(invalid="ignore", over="ignore"):
        out = 4 * P.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(P, axis=1).max() * np.linalg.norm(Q, axis=1)
    return np.where(np.isfinite(out), out, np.finfo(np.float64).max)


def _candidates(S: np.ndarray, kk: int, slack: np.ndarray):
    """A superset of the top-``kk`` cells of every column: the cells within ``slack`` of the ``kk``-th best score.

    Without slack exactly ``kk`` cells stay: rows must be in ascending point-id order, so the row
    order breaks score ties like the id does. Fast path: the kk-th best score among the first rows
    is a lower bound of the column's true kk-th score, so one comparison pass keeps a small
    superset that is then cut. Heavy ties (or tiny blocks) take the exact path.
    """
    n, m = S.shape
    if n > 2 * _PROBE_ROWS and kk < _PROBE_ROWS:
        bound = np.partition(S[:_PROBE_ROWS], _PROBE_ROWS - kk, axis=0)[_PROBE_ROWS - kk] - slack
        # NaN never passes a comparison; a -inf bound must still exclude masked cells
        bound = np.where(np.isneginf(bound), np.finfo(np.float64).min, bound)
        above = S >= bound[None, :]
        if not np.isnan(bound).any() and 0 < np.count_nonzero(above) <= 32 * kk * m:
            r, c = divmod(np.flatnonzero(above), m)
            order = np.lexsort((r, -S[r, c], c))
            r, c = r[order], c[order]
            s = S[r, c]
            starts = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
            count = np.diff(np.r_[starts, len(c)])
            pos = np.arange(len(c)) - np.repeat(starts, count)
            kth = np.repeat(s[starts + np.minimum(kk, count) - 1], count)
            keep = (pos < kk) | ((slack[c] > 0) & (s >= kth - slack[c]))
            return r[keep], c[keep]
    S[np.isnan(S)] = -np.inf
    if n <= kk:
        return np.nonzero(S > -np.inf)
    kth = np.partition(S, n - kk, axis=0)[n - kk][None, :]
    if slack.any():
        return np.nonzero((S >= kth - slack[None, :]) & (S > -np.inf))
    above = S > kth
    tie = S == kth
    need = kk - above.sum(axis=0)
    cand = above | tie
    excess = np.flatnonzero(tie.sum(axis=0) > need)  # columns with more ties than slots
    if len(excess):
        sub = tie[:, excess]
        cand[:, excess] = above[:, excess] | (sub & (np.cumsum(sub, axis=0) <= need[excess][None, :]))
    cand &= S > -np.inf
    return np.nonzero(cand)


def _best(P: np.ndarray, Q: np.ndarray, threshold: float | None, kk: int, slack: np.ndarray):
    """The best ``kk`` rows of ``P`` (which are in the order of their ids) per question: question, row and score.

    The matrix product finds the candidates; their scores are then summed in the order of the
    dimensions, so score and rank of a pair are the same in every grid and partitioning."""
    with np.errstate(invalid="ignore", over="ignore"):
        S = P @ Q.T
    if threshold is not None:
        S[S < threshold - slack[None, :]] = -np.inf
    r, c = _candidates(S, kk, slack)
    s = S[r, c]
    if slack.any():
        s = np.zeros(len(r))
        for d in range(P.shape[1]):
            s += P[r, d] * Q[c, d]
        ok = ~np.isnan(s) if threshold is None else s >= threshold
        r, c, s = r[ok], c[ok], s[ok]
    return _select_topk(c, r, s, kk)[:3]


def _scored(P: np.ndarray, Q: np.ndarray, threshold: float | None, kk: int):
    """:func:`_best` for as many questions at once as the budget holds."""
    step = max(1, _CELL_BUDGET // len(P))
    slack = _slack(P, Q)  # looks at all points, so once for all steps
    found = []
    for lo in range(0, len(Q), step):
        q, r, s = _best(P, Q[lo:lo + step], threshold, kk, slack[lo:lo + step])
        found.append((q + lo, r, s))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cell(kk: int, threshold: float | None, metric: str, key: str, point_id: str, key_type: pa.DataType, id_type: pa.DataType, parts=None):
    """One cell of the grid: two blocks of vectors -> the ``kk`` best points of each question. ``parts(questions, P, Q)`` gives the
    rows (ascending) of points and questions that are scored with one another; without it all are."""
    schema = pa.schema([(key, key_type), (point_id, id_type), ("score", pa.float64())])

    def run(questions: pa.Table, points: pa.Table) -> pa.Table:
        if not questions.num_rows or not points.num_rows:
            return schema.empty_table()
        points = points.sort_by("p_id")
        P, Q = _matrix(points.column("p_vec")), _matrix(questions.column("q_vec"))
        if metric == "cosine":
            P, Q = _unit(P), _unit(Q)
        if parts is None:
            q, r, s = _scored(P, Q, threshold, kk)
        else:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for rows, asked in parts(questions, P, Q):
                q, r, s = _scored(P[rows], Q[asked], threshold, kk)
                found.append((asked[q], rows[r], s))
            q, r, s = _select_topk(*(np.concatenate(x) for x in zip(*found)), kk)[:3]
        return pa.Table.from_arrays([questions.column("q_key").take(pa.array(q)), points.column("p_id").take(pa.array(r)),
                                     pa.array(s, pa.float64())], schema=schema)

    return run


# ----------------------------------------------------------------------------- the grid

def _key_sets(counts: list) -> list[list[str]]:
    return sorted({tuple(r["keys"]) for r in counts if r["keys"] is not None})


def _pushed(points: DataFrame, counts: list) -> Column | None:
    """Values that some question asks for, as a plain predicate on the scan; None if a question asks for all points."""
    if not counts or any(not r["keys"] for r in counts) or len(counts) > _PUSHED:
        return None
    out = None
    for keys in _key_sets(counts):
        one = None
        for i, name in enumerate(keys):
            values = sorted({r["vals"][i] for r in counts if tuple(r["keys"]) == keys})
            test = F.col(name).isin([FL.restored(v, points.schema[name].dataType) for v in values])
            one = test if one is None else one & test
        out = one if out is None else out | one
    return out


def _laid_out(points: DataFrame, sets: list[tuple]) -> Column:
    """A point's groups: for each set of keys, the keys and the point's values (null if one is missing)."""
    kinds = "struct<keys:array<string>,vals:array<string>>"
    groups = []
    for keys in sets:
        vals = [FL.canonical(F.col(k), points.schema[k].dataType) for k in keys]
        whole = F.lit(True)
        for v in vals:
            whole = whole & v.isNotNull()
        both = F.struct(F.array(*map(F.lit, keys)).cast("array<string>").alias("keys"), F.array(*vals).cast("array<string>").alias("vals"))
        groups.append(F.when(whole, both).cast(kinds))
    return F.filter(F.array(*groups), lambda g: g.isNotNull())


def _blocks(n: str, budget: int) -> Column:
    """Blocks of at most ``budget`` bytes for ``n`` vectors of ``dim`` numbers."""
    return F.ceil(F.col(n) * (F.col("dim") * 8 + _ROW_OVERHEAD) / F.lit(budget)).cast("int")


def similarity_topk(questions: DataFrame, points: DataFrame, k: int, *, key: str = "event_id",
                    query_vector: str = "qvec", metadata_filter: str | None = None,
                    point_id: str = "id", vector: str = "vector", filter_keys: list[str] | None = None,
                    must=(), should=(), search_params: dict | None = None, metric: str = "dot",
                    block_bytes: int = BLOCK_BYTES, info: dict | None = None) -> DataFrame:
    """Top-k points per question: ``(key, rank, point_id, score)``; rank starts at 1. ``key`` is unique among questions.

    * ``metadata_filter``: column of canonical must-specs per question (see
      :func:`filters.metadata_must`), matched against ``filter_keys`` columns of points.
    * ``must`` / ``should``: static filters for every question (pushed to the scan).
    * ``search_params``: ``offset`` and ``score_threshold`` (others raise).
    * ``info``: filled with the number of questions (the hits are at most ``n_questions * k``), of cells, and the
      collection's vector size ``dim``.

    A question whose vector is null, empty, or of a size that no point has, has no hits.
    """
    info = info if info is not None else {}
    if k <= 0:
        raise ValueError("k must be positive")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    offset, threshold = FL.search_options(search_params)
    spark = questions.sparkSession
    static = FL.must_should_predicate(points, must, should)
    if static is not None:
        points = points.where(static)
    points = points.where(F.size(vector) > 0)
    filter_keys = [c for c in (filter_keys or []) if c in points.columns]
    key_type, id_type = questions.schema[key].dataType, points.schema[point_id].dataType
    empty_schema = T.StructType([T.StructField(key, key_type), T.StructField("rank", T.IntegerType()),
                                 T.StructField(point_id, id_type), T.StructField("score", T.DoubleType())])
    group = FL.spec_group(metadata_filter, points.schema, filter_keys) if metadata_filter else FL.no_group()
    q = questions.where(F.size(query_vector) > 0).select(F.col(key).alias("q_key"), F.col(query_vector).alias("q_vec"), group.alias("g")) \
        .where("g IS NOT NULL").select("q_key", "q_vec", "g.keys", "g.vals", F.size("q_vec").alias("dim"))
    asked = asked_groups(q, _GROUP)
    sets = _key_sets(asked.rows if asked.few else asked.df.select("keys").distinct().collect())  # bounded by the columns of the collection
    pushed = _pushed(points, asked.rows) if asked.few else None
    p = (points if pushed is None else points.where(pushed)).select(
        F.col(point_id).alias("p_id"), F.col(vector).alias("p_vec"), F.size(vector).alias("dim"), F.explode(_laid_out(points, sets)).alias("g")) \
        .select("p_id", "p_vec", "g.keys", "g.vals", "dim") if sets else None
    best = p is not None and grid(q, p, _GROUP, asked, k + offset, threshold, metric, (key, key_type), (point_id, id_type), block_bytes, info)
    info.setdefault("n_questions", 0)
    if "dim" not in info:
        some = points.select(F.size(vector)).first()
        if some is not None:
            info["dim"] = some[0]
    return _global_topk(best, key, point_id, k + offset, offset) if best else spark.createDataFrame([], empty_schema)


@dataclass
class Asked:
    """The groups of a question table and the questions in each; ``rows`` holds them if they are ``few``."""

    df: DataFrame
    rows: list
    few: bool


def asked_groups(q: DataFrame, group: list[str]) -> Asked:
    df = q.groupBy(*group).agg(F.count(F.lit(1)).alias("nq"))
    rows = df.limit(GROUPS + 1).collect()
    few = len(rows) <= GROUPS
    return Asked(F.broadcast(q.sparkSession.createDataFrame(rows, df.schema)) if few else df, rows, few)


def grid(q: DataFrame, p: DataFrame, group: list[str], asked: Asked, kk: int, threshold: float | None, metric: str,
         key: tuple, point: tuple, block_bytes: int, info: dict, counted: DataFrame | None = None, parts=None) -> DataFrame | None:
    """The ``kk`` best points of each question in each cell. ``q``: q_key, q_vec and the columns of ``group`` (with
    ``dim``, the vector's size); ``p``: p_id, p_vec and the same. None if no group has rows on both sides.
    ``counted``: the points of each group (``np``) if they are known; ``parts``: see :func:`_cell`."""
    spark = q.sparkSession
    counted = p.groupBy(*group).agg(F.count(F.lit(1)).alias("np")) if counted is None else counted
    sizes = counted.join(asked.df, group)
    sizes = sizes.select(*group, "nq", "np", _blocks("nq", block_bytes).alias("rows"), _blocks("np", block_bytes).alias("cols"))
    if asked.few:
        info["n_questions"] = sum(r["nq"] for r in asked.rows)
        found = sizes.collect()  # at most a row for each group that is asked for
        info["cells"] = sum(r["rows"] * r["cols"] for r in found)
        info["pairs"] = sum(r["nq"] * r["np"] for r in found)
        dims = {r["dim"] for r in found}
        if len({r["dim"] for r in asked.rows}) == 1 and dims:
            info["dim"] = dims.pop()
        if not found:
            return None
        sizes = F.broadcast(spark.createDataFrame(found, sizes.schema))
    else:
        info["n_questions"] = None
    # a block is chosen by the whole row, so equal ids or vectors do not meet in one
    row = F.pmod(F.xxhash64("q_key", "q_vec"), F.col("rows")).cast("int")
    col = F.pmod(F.xxhash64("p_id"), F.col("cols")).cast("int")
    cell = [*group, "row", "col"]
    left = q.join(sizes, group).select("q_key", "q_vec", *group, row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    right = p.join(sizes, group).select("p_id", "p_vec", *group, col.alias("col"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    right = right.select("p_id", "p_vec", *[F.col(c).alias(f"p_{c}") for c in cell])
    (key_name, key_type), (id_name, id_type) = key, point
    schema = T.StructType([T.StructField(key_name, key_type), T.StructField(id_name, id_type), T.StructField("score", T.DoubleType())])
    run = _cell(kk, threshold, metric, key_name, id_name, to_arrow_type(key_type), to_arrow_type(id_type), parts)
    return left.groupBy(*cell).cogroup(right.groupBy(*[f"p_{c}" for c in cell])).applyInArrow(run, schema)


def _global_topk(cands: DataFrame, key: str, pid: str, kk: int, offset: int) -> DataFrame:
    """Per-cell candidates -> global top-kk per question (``row_number``; the planner adds a
    partial ``WindowGroupLimit`` before the shuffle), minus the first ``offset``."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(pid).asc())
    ranked = cands.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= kk)
    return ranked.where(F.col("_rn") > offset).select(
        key, (F.col("_rn") - offset).alias("rank"), pid, "score")


def adhoc_query(points: DataFrame, query: list[float], limit: int = 3, *, point_id: str = "id",
                vector: str = "vector") -> DataFrame:
    """One literal query vector -> ``limit`` best points (planned as TakeOrderedAndProject)."""
    from ..functions.vectors import dot

    qv = F.array(*[F.lit(float(x)) for x in query])
    scored = points.withColumn("score", dot(F.col(vector), qv))
    return scored.orderBy(F.col("score").desc(), F.col(point_id).asc()).limit(limit)
