import json
import os


from qaflow.session import shared_path
from qaflow.sources import articles as A
from qaflow.sources import evallog as EL
from qaflow.sources.requests import validate_json_requests


def test_patch_semantics(spark):
    cur = spark.createDataFrame([("1", "a", None, None), ("2", "b", None, None), ("3", "c", None, None)],
                                "doc_id string, text string, created_by string, created_date timestamp")
    patch = spark.createDataFrame([("1", "A", "u", None, 1), ("2", "", "u", None, 1), ("3", None, "u", None, 1),
                                   ("4", "d", "u", None, 1), ("4", "D", "u", None, 2)],
                                  "doc_id string, text string, created_by string, created_date timestamp, seq int")
    out = {r.doc_id: r.text for r in A.apply_patch(cur, patch).collect()}
    assert out == {"1": "A", "4": "D"}
    got = A.get_articles(A.apply_patch(cur, patch), "4").collect()
    assert [r.text for r in got] == ["D"]


def test_json_array_file_and_defaults(spark):
    path = shared_path(spark, "json-array")
    local = path.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "articles.json"), "w") as f:
        json.dump([{"doc_id": "1", "text": "x"}, {"doc_id": "2", "text": "y", "title": "T"}, {"text": "z"}], f)
    df = A.with_defaults(A.read_articles_json(spark, path))
    got = {(r.doc_id, r.title, r.valid) for r in df.collect()}
    assert got == {("1", "Title: 1", True), ("2", "T", True), (None, None, False)}


def test_trim_keeps_order_then_filters(spark):
    df = spark.createDataFrame([(i, "x" * (i * 100)) for i in range(20)] + [(20, None)], "pos int, text string")
    out = [r.pos for r in A.trim_articles(df, "pos", head=12, max_chars=1000).orderBy("pos").collect()]
    assert out == list(range(10))


def test_eval_log_roundtrip(spark):
    path = shared_path(spark, "evallog-test")
    m = spark.createDataFrame([("00000000-0000-0000-0000-0000000000012024-03-17 10:00:00.000001", "prompt", "p"),
                               ("00000000-0000-0000-0000-0000000000022024-03-18 10:00:00.000001", "prompt", "q")],
                              "event_id string, metric string, value string")
    EL.write(EL.records(m), path)
    allr = EL.read(spark, path)
    assert allr.count() == 2
    one = EL.read(spark, path, m.first().event_id).collect()
    assert len(one) == 1 and json.loads(one[0].log) == {"metric": "prompt", "value": "p"}
    assert EL.delete(allr, m.first().event_id).count() == 1 and EL.delete(allr).count() == 0
    allr.createOrReplaceTempView("eval_test_view")
    assert EL.latest_of_day(spark, "eval_test_view", "2024-03-18").first().log.find('"q"') > 0


def test_request_validation(spark):
    lines = spark.createDataFrame([('{"user_query": "hi"}',), ('{"user_query": 5}',), ('{"metadata": {}}',),
                                   ('{"user_query": "x", "metadata": {"region": "NZ", "n": 1}}',), ("not json",),
                                   ('{"user_query": "y", "metadata": [1]}',)], "value string")
    got = [(r.valid, r.user_query, r.metadata) for r in validate_json_requests(lines).collect()]
    assert got[0] == (True, "hi", {})
    assert got[1][0] is False and got[2][0] is False and got[4][0] is False and got[5][0] is False
    assert got[3] == (True, "x", {"region": '"NZ"', "n": "1"})
    nested = spark.createDataFrame([('{"user_query": "z", "metadata": {"a": [1]}}',), ('{"user_query": "z", "metadata": {"a": "1"}}',)], "value string")
    assert [(r.valid, r.metadata) for r in validate_json_requests(nested).collect()] == [(False, None), (True, {"a": '"1"'})]


def test_hot_key_patch_is_combined_map_side(spark):
    # one doc id holds a third of the patch rows; the last one (highest seq) must win
    rows = [("hot", f"v{i}", "u", None, i) for i in range(300)] + \
           [(f"d{i}", f"t{i}", "u", None, 1) for i in range(600)]
    patch = spark.createDataFrame(rows, "doc_id string, text string, created_by string, created_date timestamp, seq int") \
        .repartition(6)
    cur = spark.createDataFrame([("hot", "old", None, None)],
                                "doc_id string, text string, created_by string, created_date timestamp")
    out = A.apply_patch(cur, patch)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got["hot"] == "v299" and len(got) == 601
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan
