"""Cases in which copies or labels got lost, or columns of other names got in the way."""

import random

import pytest
from pyspark.sql import functions as F

from qaflow.llm import decontaminate, jaccard_join, line_templates, simhash, toxicity

CLASH = ["node", "_node", "_new", "_lines", "_gone", "_id", "_th", "_text_hash", "_text_key", "_key", "hit_spans", "_hit_spans", "rid", "lines", "new", "LEAF", "_raw"]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(f"value {k}"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


def prose(rng, lines, words=12):
    return "\n".join(" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 4) + rng.choice("aeiou") for _ in range(words)) for _ in range(lines))


def test_copies_reach_the_join_whole(spark):
    rng = random.Random(1)
    base, foot = prose(rng, 20), "this very same passage stands at the foot of many documents of this site\nand so does its second line here"
    rows = [(0, base), (1, base), (2, base), (3, base + "\none more line at the end of it")]
    rows += [(10 + k, prose(rng, 12) + "\n" + foot) for k in range(6)]
    rows += [(30 + k, foot) for k in range(2)]  # nothing but repeated lines, of a much longer first document
    out = line_templates.without_repeated_lines(docs_of(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] for i in (0, 1, 2, 3)] == [t for _, t in rows[:4]]
    assert got[10].endswith(foot) and all(foot.split("\n")[0] not in got[10 + k] for k in range(1, 6))
    assert 30 not in got and 31 not in got
    left = {r.doc_id for r in jaccard_join.one_of_each(out).collect()}
    assert left == {0, 10, 11, 12, 13, 14, 15}


def test_clashing_names_are_kept(spark):
    rng = random.Random(2)
    base = prose(rng, 8)
    rows = [(0, base), (1, base), (2, prose(rng, 5)), (None, prose(rng, 3)), (4, None), (5, "")]
    df = docs_of(spark, rows)
    bench = spark.createDataFrame([(1, base.split("\n")[2])], "item_id bigint, text string")
    for out in (line_templates.without_repeated_lines(df), jaccard_join.one_of_each(df), decontaminate.clean(df, bench), decontaminate.clean(df, bench, spans=True)):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[name] for name in CLASH] == [f"value {k}" for k in range(len(CLASH))]
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {2, None, 4, 5}
    assert decontaminate.scan(decontaminate.clean(df, bench, spans=True), bench).filter("contaminated").count() == 0
    assert line_templates.drop_lines(df).count() == len(rows)


@pytest.mark.parametrize("more", [0, 30_000])
def test_labels_without_a_document_change_nothing(spark, more):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["good", "day", "tree", "river"], k=12)) + (" vile nasty" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string")  # some ids stand twice
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    if more:
        labels = labels.unionByName(spark.range(1000, 1000 + more).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    flagged = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).filter("toxic").collect()}
    assert flagged == {i for i in range(400) if i % 4 == 0}


def test_rows_with_one_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 6)
    rows = [(i, prose(rng, 4)) for i in range(40)] + [(50, base), (51, base), (52, base + "\none more"), (None, base), (60, None), (61, "")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").repartition(3)
    names = lambda: sorted(map(tuple, jaccard_join.similar_groups(docs).collect()), key=str)
    want, kept = names(), sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect())
    whole = jaccard_join.row_hash
    assert jaccard_join.shared_hashes(docs) is None
    monkeypatch.setattr(jaccard_join, "row_hash", lambda seed: whole(seed) % 5 if seed == 0 else whole(seed))
    assert jaccard_join.shared_hashes(docs).count() > 5
    assert names() == want and sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()) == kept
    assert [d for d, _, c in want if c == 50] == [50, 51, 52, None] and len(kept) == 43


def test_sketch_adds_up_over_any_partitions(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 3)) for i in range(60)], "doc_id bigint, text string")
    one, many = (jaccard_join.frequency_sketch(docs.repartition(n), 5) for n in (1, 130))
    assert (one == many).all() and one.sum() == 60 * (36 - 4)


def test_repeated_rows_of_one_document_each_return(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 3)) for i in range(0, 300, 50)] + [(7, None), (None, prose(rng, 2)), (None, "")]
    again = rows + rows[:2] * 3 + rows[-2:]
    make = lambda rs, n: simhash.compare(spark.createDataFrame(rs, "doc_id bigint, text string").repartition(n)).drop("n_near").collect()
    once, many = make(rows, 2), make(again, 5)
    assert len(once) == len(rows) and len(many) == len(again) and set(map(tuple, many)) == set(map(tuple, once))
    assert [sum(r.doc_id == d for r in many) for d in (0, 50, 100, 7, None)] == [4, 4, 1, 1, 4]
    near = {r.doc_id: r.n_near for r in simhash.compare(spark.createDataFrame(again, "doc_id bigint, text string")).collect()}
    assert near[0] == near[50] == 3 and near[100] == 0 and near[7] is None
