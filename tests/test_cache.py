"""The tolerance join against a full scan, and the life of cache entries over two batches."""

import time

import numpy as np
import pytest

from qaflow.config import CacheConfig
from qaflow.operators import cache as C
from qaflow.operators.retrieve import CONTEXTS_TYPE

CACHE = f"cache_id long, cvec array<double>, user_query string, contexts {CONTEXTS_TYPE.simpleString()}, response string, ts timestamp_ntz"


def made(seed, n=400, m=120):
    rnd = np.random.RandomState(seed)
    centres = rnd.normal(size=(12, 8))
    hot = centres[0] / np.linalg.norm(centres[0])
    cached = [(i, (hot if i % 3 == 0 else centres[i % 12] + rnd.normal(size=8) * rnd.choice([0.02, 0.2, 0.6])).tolist()) for i in range(n)]
    asked = [(f"e{i}", (centres[i % 12] * rnd.uniform(0.1, 9) + rnd.normal(size=8) * rnd.choice([0.01, 0.3])).tolist()) for i in range(m)]
    asked += [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("none", None), ("hole", [1.0, None] + [0.5] * 6)]
    cached += [(9000, [0.0] * 8), (9001, None), (9002, [1.0]), (9003, cached[1][1])]
    return cached, asked


def full_scan(cached, asked, tolerance):
    want = {}
    for e, q in asked:
        if not q or None in q or len(q) != 8 or not any(q):
            continue
        best = None
        for i, c in cached:
            if c and len(c) == 8 and any(c):
                d = 1 - np.dot(q, c) / (np.linalg.norm(q) * np.linalg.norm(c))
                if best is None or d < best[0] - 1e-12:
                    best = (d, i)
        if best[0] <= tolerance:
            want[e] = best
    return want


@pytest.mark.parametrize("tolerance", [0.001, 0.05, 0.25, 1.5])
def test_equals_the_full_scan(spark, tolerance):
    cached, asked = made(3)
    cache = spark.createDataFrame([(i, v, "q", [], f"answer {i}", None) for i, v in cached], CACHE).repartition(5)
    q = spark.createDataFrame(asked, "event_id string, qvec array<double>").repartition(3)
    info: dict = {}
    got = {r.event_id: (r.distance, r.cache_id, r.response) for r in C.cache_lookup(q, cache, CacheConfig(match_tolerance=tolerance), info=info).collect()}
    want = full_scan(cached, asked, tolerance)
    assert set(got) == set(want) and (tolerance > 1 or 0 < len(want) < len(asked))
    for e, (d, i) in want.items():
        assert abs(got[e][0] - d) < 1e-9 and got[e][2] == f"answer {got[e][1]}"
        assert got[e][1] == i or abs(full_scan([(j, v) for j, v in cached if j == got[e][1]], [(e, dict(asked)[e])], 9)[e][0] - d) < 1e-9
    if tolerance <= 0.05:
        assert info["pruned"] > 0.5
    assert C.cache_lookup(q, cache.limit(0), CacheConfig()).count() == 0


def test_store_size_and_replays(spark):
    from pyspark.sql import functions as F

    from qaflow.session import shared_path

    store = C.CacheStore(spark, shared_path(spark, "cache"), buckets=4)
    assert store.read().count() == 0

    def entries(ids, text):
        rows = spark.createDataFrame([(i, [float(i), 1.0], "q", [(1, "d", text, 1.0, None, None, False)], text) for i in ids], CACHE.replace(", ts timestamp_ntz", "").replace("double", "float"))
        return rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("cache_id").cast("double")))

    store.keep(entries([1, 2, 2, 3], "old"), batch="a")
    store.keep(entries([9], "replayed"), batch="a")
    store.keep(entries([3, 4, 5], "new"), size=3, batch="b")
    assert {r.cache_id: r.response for r in store.read().collect()} == {3: "old", 4: "new", 5: "new"}
    store.compact()
    store.vacuum()
    assert {r.cache_id: r.contexts[0].text for r in store.read().collect()} == {3: "old", 4: "new", 5: "new"}


def test_copies_for_cells_are_handed_on_in_small_parts():
    import pyarrow as pa

    rnd = np.random.RandomState(5)
    pivots = rnd.normal(size=(32, 64))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    asked = pa.RecordBatch.from_pydict({"event_id": [f"e{i}" for i in range(3000)], "qvec": pa.array(rnd.normal(size=(3000, 64)).tolist())})
    dealt = list(C._cells("q", pivots, 0.3, "event_id", "qvec")(iter([asked])))
    assert sum(b.num_rows for b in dealt) > 50_000 and max(b.num_rows for b in dealt) * 64 * 8 <= 2 << 20
    assert {k for b in dealt for k in b.column("q_key").to_pylist()} == set(asked.column("event_id").to_pylist())


@pytest.mark.parametrize("block_bytes", [3000, 60_000, 8 << 20])
def test_a_question_is_copied_once_for_a_block(spark, block_bytes):
    rnd = np.random.RandomState(7)
    cached = [(i, rnd.normal(size=8).tolist()) for i in range(300)]
    asked = [(f"e{i}", (np.array(cached[i % 300][1]) + rnd.normal(size=8) * rnd.choice([0.02, 0.1, 1])).tolist()) for i in range(150)]
    cache = spark.createDataFrame([(i, v, "q", [], "a", None) for i, v in cached], CACHE).repartition(3)
    q = spark.createDataFrame(asked, "event_id string, qvec array<double>").repartition(2)
    info: dict = {}
    got = {r.event_id: (r.cache_id, r.score) for r in C.nearest_within(q, cache, 0.05, block_bytes=block_bytes, info=info).collect()}
    want = full_scan(cached, asked, 0.05)
    assert 0 < len(want) < len(asked)
    for e, (d, i) in want.items():
        assert got[e][0] == i and abs(1 - got[e][1] - d) < 1e-9
    if block_bytes >= 8 << 20:
        assert info["cells"] == 1  # one block holds the whole cache, so each vector is sent once


def test_bins_of_a_block_are_scored_by_themselves():
    rnd = np.random.RandomState(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, P, Q = (unit(rnd.normal(size=(n, 5))) for n in (6, 500, 1500))
    radius = 0.1
    _, cell, ring = C._bins("p", C._away(P, pivots), radius)
    bins, n = np.unique(np.stack([cell, ring]), axis=1, return_counts=True)
    packed = C._Packed([{"cell": c, "ring": r, "n": k} for (c, r), k in zip(bins.T, n)], 5, 1 << 14)
    assert len(set(packed.block)) > 1 and all(np.diff(packed.block) >= 0)

    class Block:
        def column(self, name):
            import pyarrow as pa
            return pa.array([0])

    parts = C._parts(pivots, radius, packed, set())(Block(), P, Q)
    scored = {(int(p), int(q)) for points, asked in parts for p in points for q in asked}
    assert sum(len(p) * len(q) for p, q in parts) == len(scored) < 0.5 * len(P) * len(Q)
    near = np.argwhere(np.linalg.norm(P[:, None] - Q[None], axis=2) <= radius - 1e-6)
    assert len(near) and {(int(p), int(q)) for p, q in near} <= scored
    assert [len(x) for x in C._parts(pivots, radius, packed, {0})(Block(), P, Q)[0]] == [500, 1500]


def test_requests_are_read_once_and_shuffles_of_a_write_go(spark):
    from pyspark.sql import functions as F

    from qaflow.plans.pipeline import Pipeline
    from qaflow.session import materialised, shared_path

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(f"e{i}", "what is it?", {"label": str(i % 2)}, [1.0 + i, 2.0, -1.0 * i]) for i in range(20)]
    schema = "event_id string, user_query string, metadata map<string,string>, qvec array<double>"
    asked = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    points = spark.createDataFrame([(i, [1.0 + i, 2.0, -1.0 * i], f"d{i}", f"text {i}", i % 2) for i in range(20)],
                                   "id long, vector array<double>, doc_id string, text string, label int")
    store = C.CacheStore(spark, shared_path(spark, "cache"), buckets=2)
    entry = spark.createDataFrame([(1, [1.0, 2.0, 0.0], "q", [(1, "d0", "cached", 1.0, None, None, False)], "a")], CACHE.replace(", ts timestamp_ntz", "").replace("double", "float"))
    store.keep(entry.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), batch="a")
    p = Pipeline(points=points, filter_keys=["label"], cache_store=store, stages=["SECURITY", "RCACHE", "RETRIEVE", "CONSOLIDATE", "GENERATE", "WCACHE"])
    state, _ = p.run(asked, batch="b")
    hits = {r.event_id: r.cache_hit for r in state.collect()}
    assert len(hits) == 20 and hits["e0"] and not hits["e19"]
    assert read.value == 20

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    written = materialised(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "written")
    left = lambda: {f for f in files() - before if f.startswith("shuffle_")}
    until = time.time() + 20
    while left() and time.time() < until:
        time.sleep(0.2)
    assert not left() and written.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_one_version_of_changes_is_read_without_a_shuffle(spark):
    from qaflow.session import shared_path

    def entries(ids, text):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame([(i, [float(i), 1.0], "q", [(1, "d", text, 1.0, None, None, False)], text) for i in ids], CACHE.replace(", ts timestamp_ntz", "").replace("double", "float"))
        return rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))

    store = C.CacheStore(spark, shared_path(spark, "cache"), buckets=2)
    store.keep(entries([1, 2, 2, 3], "a"), batch="a")
    assert "Exchange" not in store.read()._jdf.queryExecution().toString()
    assert sorted(r.cache_id for r in store.read().collect()) == [1, 2, 3]
    store.delete(store.read().where("cache_id = 2"))
    store.keep(entries([4], "b"), batch="b")
    assert sorted(r.cache_id for r in store.read().collect()) == [1, 3, 4]
