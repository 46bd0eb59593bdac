"""Which stages a row meets: traces are compared with a walk over the stage numbers in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from qaflow import constants as K
from qaflow.plans import routing as RT


def walk(present, linked, jump=None):
    """Stages met by a row that starts at SECURITY, and where it stands at the end; ``jump``: a stage and where it sends the row."""
    at, met = K.SECURITY, []
    for i, stage in enumerate(present):
        if at != stage:
            continue
        if jump and jump[0] == stage:
            at = jump[1]
            continue
        met.append(stage)
        if linked:
            at = present[i + 1] if i + 1 < len(present) else None
        else:
            at = stage + 1 if stage < K.LAST_STAGE else None
    return met, at


def traced(spark, texts, stages, linked):
    df = RT.start(spark.createDataFrame([(t,) for t in texts], "text string"), K.SECURITY)
    return {r.text.split("|")[0]: ([int(x) for x in r.text.split("|")[1:]], r.sentinel, r.errors) for r in RT.run_stages(df, stages, linked=linked).collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("linked", [True, False])
def test_any_list_of_stages(spark, seed, linked):
    rng = random.Random(seed)
    present = sorted({K.SECURITY, *rng.sample(range(K.LAST_STAGE + 1), rng.randint(1, 7))})
    got = traced(spark, ["some question"], [RT.trace_stage(s) for s in present], linked)
    assert got == {"some question": (*walk(present, linked), [])}


def test_rows_of_one_table_take_different_ways(spark):
    stages = RT.all_trace_stages()
    assert [s.stage for s in stages] == list(range(K.LAST_STAGE + 1))
    stages[K.RCACHE] = RT.trace_cache_stage(lambda t: t.startswith("known"))
    got = traced(spark, ["known question", "new question"], stages, False)
    everything = list(range(K.LAST_STAGE + 1))
    assert got["known question"][:2] == walk(everything, False, (K.RCACHE, K.GENERATE))
    assert got["new question"][:2] == walk(everything, False, (K.RCACHE, K.REWRITE))


def test_increment(spark):
    df = spark.createDataFrame([(s,) for s in [-1, 0, 3, 6, 7, None]], "s int")
    got = [r.n for r in df.select(RT.increment(F.col("s")).alias("n")).collect()]
    assert got == [0, 1, 4, 7, None, None]


def test_error_accumulation(spark):
    df = RT.start(spark.createDataFrame([(1,), (2,)], "x int"), K.SECURITY)
    df = df.withColumn("errors", RT.append_error(F.col("errors"), F.col("x") == 2, K.RETRIEVE, "E", "boom"))
    got = {r.x: [(e.stage, e.error_type, e.message) for e in r.errors] for r in df.collect()}
    assert got == {1: [], 2: [(3, "E", "boom")]}
