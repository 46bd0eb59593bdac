import json
import os

from qaflow.plans.pipeline import Pipeline
from qaflow.session import shared_path
from qaflow.sources import evallog as EL
from qaflow.sources import tables as TB
from qaflow.sources.articles import ArticleStore
from qaflow.functions.vectors import hash_encoder
from qaflow.streaming.streams import answer_stream, intake_stream, patch_stream
from tests.conftest import SF_SMALL


def _local(p):
    return p.replace("file:", "")


def test_answer_stream_available_now(spark):
    src = shared_path(spark, "req-src")
    os.makedirs(_local(src), exist_ok=True)
    q = TB.questions(spark, SF_SMALL).orderBy("event_id").limit(20).toPandas()
    for part in range(2):
        with open(os.path.join(_local(src), f"part{part}.json"), "w") as f:
            for r in q.iloc[part * 10:(part + 1) * 10].itertuples():
                f.write(json.dumps({"event_id": r.event_id, "user_query": r.user_query,
                                    "metadata": dict(r.metadata), "qvec": [float(x) for x in r.qvec]}) + "\n")
    out, ev, ck = shared_path(spark, "ans"), shared_path(spark, "ev"), shared_path(spark, "ck")
    p = Pipeline(points=TB.collection_points(spark, SF_SMALL), filter_keys=["label"])
    answer_stream(spark, src, p, out, ck, eval_path=ev).awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.where("generated_text IS NULL").count() == 0
    assert EL.read(spark, ev).select("event_id").distinct().count() == 20


def test_patch_stream_versions(spark):
    store = ArticleStore(spark, shared_path(spark, "store"), buckets=4)
    store.append(spark.createDataFrame([("1", "a", None, None), ("2", "b", None, None)],
                                       "doc_id string, text string, created_by string, created_date timestamp"))
    src = shared_path(spark, "patch-src")
    os.makedirs(_local(src), exist_ok=True)
    with open(os.path.join(_local(src), "p.json"), "w") as f:
        f.write(json.dumps({"doc_id": "1", "text": "", "seq": 1}) + "\n")
        f.write(json.dumps({"doc_id": "3", "text": "c", "seq": 1}) + "\n")
    patch_stream(spark, src, store, shared_path(spark, "ck2")).awaitTermination(300)
    assert {r.doc_id: r.text for r in store.read().collect()} == {"2": "b", "3": "c"}
    # the feed is read again from the start: its batches are known
    patch_stream(spark, src, store, shared_path(spark, "ck3")).awaitTermination(300)
    assert store.version() == 1


def test_intake_answers_a_request_once(spark):
    src, out, bad, ev, ck = (shared_path(spark, x) for x in ("in", "out", "bad", "evl", "ckpt"))
    os.makedirs(_local(src), exist_ok=True)
    lines = [json.dumps({"request_id": f"r{i}", "sent_at": f"2024-03-17 10:00:{i:02d}", "user_query": f"What is {i}?"}) for i in range(6)]
    lines += ["not json", json.dumps({"request_id": "n", "sent_at": "2024-03-17 11:00:00", "user_query": 5}), json.dumps({"user_query": "without an id"})]
    p = Pipeline(points=TB.collection_points(spark, SF_SMALL), encoder=hash_encoder(64))
    for k in range(3):  # the same file, then again, then some of it in another order with one new line
        with open(os.path.join(_local(src), f"f{k}.txt"), "w") as f:
            f.write("\n".join(lines if k < 2 else lines[4::-1] + [lines[0].replace("r0", "late")]) + "\n")
        intake_stream(spark, src, p, out, bad, ck, eval_path=ev).awaitTermination(300)
    got = spark.read.parquet(out)
    # the line without an id is told apart by its file
    assert got.count() == 6 + 2 + 1 and got.select("event_id").distinct().count() == 9
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["malformed JSON"] * 2 + ["user_query must be a string"]
    recs = EL.read(spark, ev)
    assert recs.where("ts IS NULL").count() == 0
    assert EL.latest_by_ts(EL.EvalLog(spark, ev).of_day("2024-03-17"), "2024-03-17").count() == 1
