"""Objects of a JSON array file, split at any byte, against json.loads."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from qaflow.functions.text import digit_encode
from qaflow.session import shared_path
from qaflow.sources import articles as A
from qaflow.sources import json_array as J


def made(n, seed):
    rng = random.Random(seed)
    bits = ["plain", "{", "}", '"', "\\", "\\\\", "[1]", "é日😀", "\n", "{\"a\": 1}", "}}", ": ", "text " * 30]
    rows = []
    for i in range(n):
        row = {"doc_id": i if i % 3 else f"k{i}", "text": "".join(rng.choices(bits, k=rng.randint(0, 12))), "region": rng.choice(["NZ", "AU", None]), "chunk": i}
        if i % 4 == 0:
            row["nested"] = {"deep": {"er": ["}", "{", i]}, "e": {}}
        if i % 7 == 0:
            row["}odd{"] = True
        rows.append(row)
    return rows


def written(spark, texts):
    path = shared_path(spark, "json-arrays")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    for k, text in enumerate(texts):
        with open(os.path.join(path.replace("file:", ""), f"f{k}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    return path


@pytest.mark.parametrize("size", [211, 4000, 1 << 27])
def test_any_split_gives_the_same_objects(spark, size):
    rows, more = made(40, 1), made(15, 2)
    path = written(spark, [json.dumps(rows), json.dumps(more, indent=2, ensure_ascii=False) + "\n", "[]", "\n".join(json.dumps(r) for r in more), json.dumps([{}, {"a": "}" * 200}])])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = J.read_json_array(spark, path).orderBy("path", "block", "idx").collect()
        if size == 211:
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_file = {}
    for r in got:
        by_file.setdefault(os.path.basename(r.path), []).append(json.loads(r.item))
    assert by_file == {"f0.json": rows, "f1.json": more, "f3.json": more, "f4.json": [{}, {"a": "}" * 200}]}


def test_region_reaches_the_payload_and_ids_are_positions(spark):
    rows = [{"doc_id": "1", "text": "123 first", "region": "NZ", "topic": {"a": [1, "x"]}}, {"doc_id": "01", "text": "456 second", "chunk": 3}, {"doc_id": " 1", "text": "789 third", "flag": True, "title": "T"}]
    path = written(spark, [json.dumps(rows), "[{\"doc_id\": oops}, {\"doc_id\": \"9\", \"text\": \"000 last\"}]"])
    arts = J.read_articles_array(spark, path)
    assert arts.where("NOT valid").count() == 1
    coll = A.build_collection(arts.where("valid").drop("valid"), lambda t: digit_encode(t, 3), order=["path", "block", "idx"])
    got = {r.id: (r.doc_id, list(r.vector), r.payload) for r in coll.collect()}
    assert got == {0: ("1", [1.0, 2.0, 3.0], {"region": "NZ", "topic": '{"a":[1,"x"]}'}), 1: ("01", [4.0, 5.0, 6.0], {"chunk": "3"}),
                   2: (" 1", [7.0, 8.0, 9.0], {"flag": "true", "title": "T"}), 3: ("9", [0.0, 0.0, 0.0], {})}


def test_dense_ids_in_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).cast("string").alias("doc_id"), F.lit("123").alias("text")).repartition(9)
    ids = {r.doc_id: r.id for r in A.build_collection(df, lambda t: digit_encode(t, 3)).collect()}
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(ids) and sorted(ids.values()) == list(range(500))


def test_files_of_the_collection_follow_the_size_of_the_cluster(spark, monkeypatch):
    from qaflow.plans import catalog

    class Written(Exception):
        pass

    parts = []

    def write(rows, path):
        parts.append(rows.rdd.getNumPartitions())
        raise Written

    monkeypatch.setattr(J, "write_json_arrays", write)
    monkeypatch.setattr(catalog.TB, "table", lambda s, d, name: s.range(100).selectExpr("id doc_id", "id page_id", "'t' text", "'en' lang", "'s' source", "'u' url").drop(
        *(["text", "lang", "source", "doc_id"] if name == "pages" else ["url", "page_id"])))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Written):
            catalog.Q["collection_from_json"](spark, "")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
