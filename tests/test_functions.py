import pytest
from pyspark.sql import functions as F

from qaflow import constants as K
from qaflow.functions import text as TX
from qaflow.functions import vectors as V
from qaflow.operators import generate as G
from tests.fixtures import contexts_df, meta

QUERY = "Please refund 4000 0012 3456 7899, my train was late."


def test_redaction(spark):
    df = spark.createDataFrame([(QUERY,), ("card 1234567890123456 stays",), ("x1234 5678 9012 3456",)], "t string")
    got = [r.r for r in df.select(TX.redact(F.col("t"), K.REDACTION_TOKENS).alias("r")).collect()]
    assert "<REDACTED: Financial information>" in got[0] and "4000 0012" not in got[0]
    assert got[1] == "card 1234567890123456 stays"
    assert got[2] == "x1234 5678 9012 3456"


def test_fallback_answers(spark):
    seen = [("Ferry times", "example.org/ferry", "Boats leave at nine."), ("Tickets", "example.org/tickets", "Two zones cost four."), ("Lost things", "example.org/lost", "Ask at the pier.")]
    df = contexts_df(spark, [("e", [meta(f"p{i}", text, i + 1, title, url) for i, (title, url, text) in enumerate(seen)])])
    r = df.select(G.fallback_answer(F.col("contexts"), "references").alias("a"),
                  G.fallback_answer(F.col("contexts"), "documents").alias("b")).first()
    assert r.a == K.NO_MODEL_REFERENCES_PREFIX + "".join(f"{i}. {title}: {url}\n" for i, (title, url, _) in enumerate(seen))
    assert r.b == K.NO_MODEL_DOCUMENTS_PREFIX + "".join(text for _, _, text in seen)


def test_prompt_and_strip(spark):
    df = spark.createDataFrame([("Q%s{x}", "c1\nc2\n")], "q string, c string")
    r = df.select(TX.build_prompt(F.col("q"), F.col("c")).alias("p"),
                  TX.build_prompt(F.col("q"), F.col("c"), "plain").alias("p2")).first()
    assert r.p == ("Given a user query, and context documents, generate a response.\nUSER_QUERY:\n'Q%s{x}'\n"
                   "CONTEXT_ITEMS:\nc1\nc2\n\n<|endoftext|>")
    assert r.p2 == "Q%s{x}c1\nc2\n<|endoftext|>"
    s = spark.createDataFrame([("abc", "abcXYZ"), ("", "XYZ")], "i string, g string")
    got = [x.s for x in s.select(TX.strip_prompt(F.col("g"), F.col("i")).alias("s")).collect()]
    assert got == ["abcXYZ"[2:], "XYZ"[-1:]]


def test_event_id_roundtrip(spark):
    df = spark.sql("SELECT 7 AS k, TIMESTAMP'2024-03-17 10:11:12.123456' AS ts")
    r = df.select(TX.event_id(F.col("k"), F.col("ts")).alias("e")).select("e", TX.event_time(F.col("e")).alias("t")).first()
    assert len(r.e) == 36 + 26 and r.e[8] == "-" and str(r.t) == "2024-03-17 10:11:12.123456"


def test_digit_encoder(spark):
    df = spark.createDataFrame([("123text1",), ("12x",)], "t string")
    got = [r.v for r in df.select(TX.digit_encode(F.col("t"), 3).alias("v")).collect()]
    assert got == [[1.0, 2.0, 3.0], None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.cosine_distance(F.col("a"), F.col("a")).alias("c")).first()
    assert r.d == 11.0 and abs(r.c) < 1e-12
    enc = V.hash_encoder(64)
    e = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",), (None,)], "t string") \
        .select(enc(F.col("t")).alias("v")).collect()
    assert len(e[0].v) == 64 and abs(sum(x * x for x in e[0].v) - 1) < 1e-5 and e[1].v is None


def test_model_encoder_loads_once_per_task(spark):
    import numpy as np

    class Fake:
        loads = 0

        def __init__(self):
            Fake.loads += 1

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    enc = V.model_encoder(Fake, 2)
    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string").coalesce(1)
    got = [r.v for r in df.select(enc(F.col("t")).alias("v")).collect()]
    assert got == [[2.0, 1.0], None, [4.0, 1.0]]


def test_model_factory_in_generation(spark):
    import pandas as pd

    from qaflow.operators.generate import ModelFactory, call_model

    def factory():
        return lambda prompts: pd.DataFrame({"text": prompts.str.upper(), "token_count": prompts.str.len()})

    df = spark.createDataFrame([("a",), (None,), ("bc",)], "prompt string")
    got = [(r.llm.text, r.llm.token_count) for r in call_model(df, ModelFactory(factory)).collect()]
    assert got == [("A", 1), (None, None), ("BC", 2)]


@pytest.mark.parametrize("bad", [None, {}, {"Financial information": None}, {"Financial information": 7}, {"Persons names": "<name>"}])
def test_redaction_fails_closed(bad):
    from qaflow.functions import text as T

    with pytest.raises(T.SecurityServiceError):
        T.redact(F.lit("card 1234 5678 9012 3456"), bad)


def test_second_redaction_kind(spark):
    from qaflow.functions import text as T

    col = T.redact(F.lit("mail a@b.cc"), {"Financial information": "<n>", "Mail": "<m>"}, {"Mail": r"\S+@\S+"})
    assert spark.range(1).select(col).first()[0] == "mail <m>"


def test_encoder_holds_the_words_of_few_texts():
    import tracemalloc

    import numpy as np
    import pandas as pd

    texts = pd.Series([None if i % 50 == 0 else " ".join(f"word{(i * 7 + j) % 5000}" for j in range(200)) for i in range(4000)])
    tracemalloc.start()
    got = V._hash_embed_batch(texts, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20 and len(got) == len(texts)
    for i in (0, 1, 1023, 1024, 3999):
        alone = V._hash_embed_batch(texts.iloc[i:i + 1].reset_index(drop=True), 16)[0]
        assert (got[i] is None and alone is None) or np.array_equal(got[i], alone)


def test_a_model_gets_prompts_only_and_few_at_once(spark):
    import pandas as pd

    from qaflow.operators.generate import call_model

    def model(prompts):
        return pd.DataFrame({"text": prompts, "token_count": [len(prompts)] * len(prompts)})

    df = spark.range(2500).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("prompt"), F.array(F.struct("id")).alias("contexts")).coalesce(1)
    out = call_model(df, model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    got = out.collect()
    assert len(got) == 2500 and all(r.llm.text == r.prompt and r.contexts[0].id == r.id for r in got)
    assert max(r.llm.token_count or 0 for r in got) <= 1000 and all((r.llm.token_count is None) == (r.prompt is None) for r in got)
