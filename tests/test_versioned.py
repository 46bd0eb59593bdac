"""Versions, merge on read, compaction and partition filters of the article store and the eval log."""

import os

import pytest
from pyspark.sql import functions as F

from qaflow.session import shared_path
from qaflow.sources import evallog as EL
from qaflow.sources.articles import ArticleStore, apply_patch
from qaflow.sources.versioned import CommitConflict

ART = "doc_id string, text string, created_by string, created_date timestamp"


def store_of(spark, rows, buckets=8):
    store = ArticleStore(spark, shared_path(spark, "store"), buckets=buckets)
    store.append(spark.createDataFrame(rows, ART))
    return store


def files(root, folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(f"{root.replace('file:', '')}/{folder}") for f in names if f.startswith("part-"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_patches_equal_the_join(spark):
    cur = [(str(i), f"text {i}", None, None) for i in range(200)]
    store = store_of(spark, cur)
    want = spark.createDataFrame(cur, ART)
    for k in range(3):
        rows = [(str(i * 7 % 260), None if i % 5 == k else "" if i % 11 == 0 else f"patch {k} {i}", "p", None, i) for i in range(90)]
        patch = spark.createDataFrame(rows, ART + ", seq int").repartition(3)
        store.apply(patch)
        want = apply_patch(want, patch)
        assert rows_of(store.read()) == rows_of(want)
        if k == 1:
            store.compact()
            assert rows_of(store.read()) == rows_of(want)
    assert store.version() == 4 and rows_of(store.read(0)) == sorted((a, b) for a, b, *_ in cur)


def test_one_id_touches_one_bucket(spark):
    store = store_of(spark, [(str(i), f"t{i}", None, None) for i in range(400)])
    before = files(store.root, "base")
    store.apply(spark.createDataFrame([("17", "new", "u", None, 1)], ART + ", seq int"))
    assert files(store.root, "base") == before and len(files(store.root, "changes")) == 1
    assert [r.text for r in store.get(["17"]).collect()] == ["new"]
    assert "PartitionFilters: [" in plan_of(store.get(["17"])) and "bucket" in plan_of(store.get(["17"])).split("PartitionFilters: [")[1].split("]")[0]
    version = store.compact()
    added = set(files(store.root, "base")) - set(before)
    assert added and all(f"v={version}/" in f for f in added) and len({os.path.dirname(f) for f in added}) == 1
    assert "left_anti" not in plan_of(store.read()).lower() and "Join" not in plan_of(store.read())
    assert store.vacuum() == 2 and not files(store.root, "changes")
    assert len(files(store.root, "base")) == len(before) - sum(os.path.basename(os.path.dirname(f)) == os.path.basename(os.path.dirname(next(iter(added)))) for f in before) + len(added)
    assert dict(rows_of(store.read()))["17"] == "new" and store.read().count() == 400
    with pytest.raises(ValueError):
        store.read(0)
    assert store.compact() == store.version() and store.vacuum() == 0


def test_unfinished_versions_and_replays(spark):
    store = store_of(spark, [("1", "a", None, None)])
    patch = spark.createDataFrame([("1", "b", None, None, 1), ("2", "c", None, None, 1)], ART + ", seq int")
    # a writer that died before its commit: its files are there, its version is not
    patch.drop("seq").withColumns({"_seq": F.lit(1).cast("long"), "_deleted": F.lit(False), "bucket": F.lit(0)}).write.partitionBy("bucket").parquet(f"{store.root}/changes/v=1")
    assert rows_of(store.read()) == [("1", "a")]
    assert store.apply(patch, batch="x") == 1 and store.apply(patch, batch="x") == 1
    assert rows_of(store.read()) == [("1", "b"), ("2", "c")]
    with pytest.raises(CommitConflict):
        store._commit(1, "changes", "y", [])


def test_a_hot_key_and_null_keys(spark):
    store = store_of(spark, [("hot", "old", None, None), (None, "nobody", None, None)])
    rows = [("hot", f"v{i:04d}", "u", None, i) for i in range(500)] + [(None, "dropped", "u", None, 1)]
    store.apply(spark.createDataFrame(rows, ART + ", seq int").repartition(5))
    assert sorted(r.text for r in store.read().collect()) == ["nobody", "v0499"]
    store.compact()
    assert sorted(r.text for r in store.read().collect()) == ["nobody", "v0499"]


def event(i, day):
    return f"00000000-0000-0000-0000-{i:012d}{day} 10:00:00.{i:06d}"


def test_eval_log(spark):
    log = EL.EvalLog(spark, shared_path(spark, "log"), buckets=4)
    days = ["2024-03-16", "2024-03-17", "2024-03-18"]
    made = [(event(i, days[i % 3]), "prompt", f"p{i}") for i in range(60)] + [("no day", "prompt", "x")]
    recs = EL.records(spark.createDataFrame(made, "event_id string, metric string, value string"))
    log.append(recs, batch="b0")
    log.append(recs, batch="b0")
    assert log.read().count() == 61 and log.version() == 0
    one = log.of_event(event(4, days[1]))
    filters = plan_of(one).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "bucket" in filters and one.count() == 1
    assert log.of_day(days[1]).count() == 21 and "day" in plan_of(log.of_day(days[1])).split("PartitionFilters: [")[1].split("]")[0]
    log.of_day(days[1]).createOrReplaceTempView("log_of_day")
    assert EL.latest_of_day(spark, "log_of_day", days[1]).first().event_id == event(58, days[1])
    log.delete(spark.createDataFrame([(event(4, days[1]),), ("no day",), ("absent",)], "event_id string"))
    assert log.of_event(event(4, days[1])).count() == 0 and log.read().count() == 59
    base = set(files(log.root, "base"))
    log.compact()
    new = set(files(log.root, "base")) - base
    assert {tuple(f.split("/")[-3:-1]) for f in new} <= {tuple(f.split("/")[-3:-1]) for f in files(log.root, "changes")}
    log.vacuum()
    left = spark.read.parquet(f"{log.root}/base")
    assert left.where(F.col("event_id").isin(event(4, days[1]), "no day")).count() == 0 and left.count() == 59
    log.append(recs.where(F.col("event_id") == event(4, days[1])), batch="b1")  # written again after its deletion
    assert log.of_event(event(4, days[1])).count() == 1 and log.read().count() == 60
