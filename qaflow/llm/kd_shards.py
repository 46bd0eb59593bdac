"""K-d tree sharding (DataFrame functions only).

Every document is a point: its size (log), the hashes of ``lang`` and ``source``. Copies of a text take the smallest
coordinates among them, so equal texts are one point. A node that owns ``k`` shards is split at the weighted median
(of bytes; at ``k // 2`` of ``k`` for odd ``k``) along its widest dimension, widths being shares of the range of all
points, until each leaf owns one shard. Points equal in that dimension are ordered by a hash of the text, then by a
hash of the id, so a cut falls between any two rows and a group larger than a shard is split as far as balance asks.

A median is found by histograms: each pass sums the bytes of ``BINS`` bins of all nodes at once (combined before the
shuffle; at most ``shards * BINS`` rows reach the driver) and zooms into the bin of the cut until that weighs less than
``TOLERANCE`` of a shard or holds one point. No row moves before the final numbering.

Law: ``bytes`` (sizes near equal). Defined cases: a null text has no bytes (size 8, crc of the empty string); null
``lang``, ``source`` or ``doc_id`` count as the empty string; repeated rows are rows of their own with neighbouring
slots; empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import or_empty, saved

SHARDS, BINS, TOLERANCE, SLOT_ROWS = 24, 1024, 1e-3, 100_000
DIMS = ("x0", "x1", "x2")
INF = float("inf")


def points(docs: DataFrame) -> DataFrame:
    has = set(docs.columns)
    name = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).cast("double") if c in has else F.lit(0.0)
    # hashes of 52 bits: exact as doubles
    small = lambda h: F.shiftrightunsigned(h, 12).cast("double")
    rows = docs.select(
        "doc_id", (F.octet_length(or_empty()) + 8).cast("bigint").alias("size"), F.crc32(or_empty().cast("binary")).alias("crc"),
        F.xxhash64(or_empty()).alias("h"), name("lang").alias("x1"), name("source").alias("x2"), small(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("t"),
    )
    rows = saved(rows, "kd-rows")
    group = rows.groupBy("h", "size").agg(F.min("x1").alias("x1"), F.min("x2").alias("x2"))
    out = rows.drop("x1", "x2").join(group, ["h", "size"]).withColumn("x0", F.log(F.col("size").cast("double"))).withColumn("g", small(F.col("h")))
    return out.select("doc_id", "size", "crc", *DIMS, "g", "t")


class Cut:
    """The search for one node's median: fields before the active one are fixed, the active one lies in ``lo..hi``."""

    def __init__(self, dim: str, lo: float, hi: float, target: float, tolerance: float):
        self.fields, self.fixed, self.lo, self.hi = (dim, "g", "t"), [], lo, hi
        self.target, self.tolerance, self.below, self.at, self.strict = target, tolerance, 0.0, None, False

    def state(self, node: int) -> tuple:
        """A row of :data:`STATE`."""
        x, y = (*self.fixed, None, None)[:2]
        return node, DIMS.index(self.fields[0]), len(self.fixed), x, y, self.lo, self.hi

    def zoom(self, bins: list) -> None:
        """``bins``: ``(bin, bytes, smallest, largest)``, sorted."""
        for _, weight, lo, hi in bins:
            if self.below + weight >= self.target or (lo, hi) == (bins[-1][2], bins[-1][3]):
                last = len(self.fixed) == 2
                if weight <= self.tolerance or lo == hi and last:
                    take = self.target - self.below > weight / 2
                    edge = hi if take else lo
                    self.at = (*self.fixed, edge, *([INF if take else -INF] * (2 - len(self.fixed))))
                    self.strict = not take
                elif lo == hi:
                    self.fixed.append(lo)
                    self.lo, self.hi = 0.0, float(1 << 52)
                else:
                    self.lo, self.hi = lo, hi
                return
            self.below += weight

    def place(self, node: int, right: int) -> tuple:
        """A row of :data:`PLACE`."""
        return node, right, DIMS.index(self.fields[0]), *self.at, self.strict


#: Broadcast below: one row for each node, at most ``shards``.
STATE = "node int, dim int, fixed int, f0 double, f1 double, lo double, hi double"
PLACE = "node int, right int, dim int, a double, b double, c double, strict boolean"


def _bins(data: DataFrame, states: list[tuple]) -> DataFrame:
    """``node, bin, w, lo, hi`` of the open searches."""
    here = data.join(F.broadcast(data.sparkSession.createDataFrame(states, STATE)), "node")
    x = F.array(*DIMS)[F.col("dim")]
    here = here.filter((F.col("fixed") < 1) | (x == F.col("f0"))).filter((F.col("fixed") < 2) | (F.col("g") == F.col("f1")))
    here = here.withColumn("v", F.when(F.col("fixed") == 0, x).when(F.col("fixed") == 1, F.col("g")).otherwise(F.col("t")))
    here = here.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).otherwise(F.lit(0.0))
    here = here.withColumn("bin", F.least(F.floor(share).cast("int"), F.lit(BINS - 1)))
    return here.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _split(data: DataFrame, places: list[tuple]) -> DataFrame:
    """Rows behind their node's cut, in the order of the three fields, go to the node on the right."""
    both = data.join(F.broadcast(data.sparkSession.createDataFrame(places, PLACE)), "node", "left")
    x, g, t = F.array(*DIMS)[F.col("dim")], F.col("g"), F.col("t")
    last = F.when(F.col("strict"), t < F.col("c")).otherwise(t <= F.col("c"))
    left = (x < F.col("a")) | ((x == F.col("a")) & ((g < F.col("b")) | ((g == F.col("b")) & last)))
    return both.withColumn("node", F.when(F.col("right").isNotNull() & ~left, F.col("right")).otherwise(F.col("node"))).select(*data.columns)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, crc, shard`` and the fields that order rows."""
    data = saved(points(docs).withColumn("node", F.lit(0)), "kd-points")
    spread = data.agg(F.sum("size"), *[F.max(d) - F.min(d) for d in DIMS]).first()
    total, widths = spread[0] or 0, [w or 0.0 for w in spread[1:]]
    nodes = {0: shards}  # first shard: shards owned
    while total and any(k > 1 for k in nodes.values()):
        stats = data.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS]).collect()
        cuts: dict[int, Cut] = {}
        nodes |= dict.fromkeys(nodes.keys() - {s["node"] for s in stats}, 1)  # without rows there is nothing to split
        for s in stats:
            if (k := nodes[s["node"]]) > 1:
                share = [(s[f"hi_{d}"] - s[f"lo_{d}"]) / w if w else 0.0 for d, w in zip(DIMS, widths, strict=True)]
                dim = DIMS[share.index(max(share))]
                cuts[s["node"]] = Cut(dim, s[f"lo_{dim}"], s[f"hi_{dim}"], s["w"] * (k // 2) / k, TOLERANCE * total / shards)
        while open_ := {n: c for n, c in cuts.items() if c.at is None}:
            found = _bins(data, [c.state(n) for n, c in open_.items()]).collect()
            for n, c in open_.items():
                c.zoom(sorted(tuple(r)[1:] for r in found if r["node"] == n))
        data = saved(_split(data, [c.place(n, n + nodes[n] // 2) for n, c in cuts.items()]), "kd-level") if cuts else data
        nodes |= {n + nodes[n] // 2: nodes[n] - nodes[n] // 2 for n in cuts} | {n: nodes[n] // 2 for n in cuts}
    return data.withColumnRenamed("node", "shard")


def numbered(data: DataFrame) -> DataFrame:
    """``slot``: gapless from 0 in each shard, by counting parts of about ``SLOT_ROWS`` rows and numbering inside each."""
    parts = data.count() // SLOT_ROWS + 1
    data = data.withColumn("part", F.pmod(F.xxhash64("t", "g"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = data.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c")).select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("t", "g")
    return data.join(counts, ["shard", "part"]).withColumn("slot", F.row_number().over(inside) - 1 + F.col("before"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    return numbered(assign(docs, shards)).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
