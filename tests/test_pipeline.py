import pandas as pd
from pyspark.sql import functions as F

from qaflow import constants as K
from qaflow.config import GenerateConfig, PipelineConfig
from qaflow.operators import generate as G
from qaflow.plans.pipeline import Pipeline, answers, metric_rows
from qaflow.sources import articles as A
from qaflow.functions.text import digit_encode


def _collection(spark, rows):
    arts = spark.createDataFrame(rows, "doc_id long, text string, region string, title string")
    coll = A.build_collection(arts, lambda t: digit_encode(t, 3))
    return coll.withColumn("payload", F.when(F.col("title").isNotNull(),
                                             F.create_map(F.lit("title"), F.col("title"), F.lit("region"), F.col("region")))
                           .otherwise(F.create_map().cast("map<string,string>")))


def _requests(spark, metadata=None):
    return spark.createDataFrame([("ev1", "What is AI?", metadata or {}, [1.0, 1.0, 1.0])],
                                 "event_id string, user_query string, metadata map<string,string>, qvec array<float>")


def test_region_filter_answer(spark):
    coll = _collection(spark, [(1, "123text1", "NZ", "New Zealand document"), (2, "456text2", "AU", "Australian document")])
    cfg = PipelineConfig(generate=GenerateConfig(no_llm_fallback_strategy="documents"))
    p = Pipeline(points=coll, config=cfg, filter_keys=["region"])
    state, _ = p.run(_requests(spark, {"region": '"NZ"'}))
    resp = answers(state).first().generated_text
    assert "123text1" in resp and "456text2" not in resp


def test_empty_collection_falls_back_and_skips_consolidate(spark):
    coll = _collection(spark, [(1, "123text1", "NZ", None)]).where("false")
    p = Pipeline(points=coll, config=PipelineConfig(generate=GenerateConfig(no_llm_fallback_strategy="documents")))
    state, _ = p.run(_requests(spark))
    r = state.first()
    assert "No relevant documents found. Perhaps reframe your query" in r.response
    stages = [e.stage for e in r.errors]
    assert K.RETRIEVE in stages and K.CONSOLIDATE not in stages
    assert r.contexts[0].text == K.NO_DOCUMENTS_PREFIX + K.FALLBACK_TAIL  # not formatted: consolidate skipped


def test_redaction_then_answer_with_model(spark):
    coll = _collection(spark, [(1, "123text1", "NZ", None), (2, "456text2", "AU", None)])
    model = G.echo_model("The answer is 42.")
    cfg = PipelineConfig(generate=GenerateConfig(model=model))
    p = Pipeline(points=coll, config=cfg)
    req = spark.createDataFrame([("ev1", "My bank account number is 1234 5678 9012 3456. Why?", {}, [1.0, 1.0, 1.0])],
                                "event_id string, user_query string, metadata map<string,string>, qvec array<float>")
    state, secs = p.run(req, timed=True)
    r = state.first()
    assert "1234 5678 9012 3456" not in r.m_prompt and "<REDACTED: Financial information>" in r.m_prompt
    assert r.response == ">The answer is 42." and r.errors == []
    names = {x.metric for x in metric_rows(state, secs).collect()}
    assert names == set(K.METRIC_NAMES)


def test_model_row_errors_become_fallbacks(spark):
    coll = _collection(spark, [(1, "123text1", "NZ", None)])

    def flaky(prompts: pd.Series) -> pd.DataFrame:
        if prompts.str.contains("fail").any():
            raise RuntimeError("model down")
        return pd.DataFrame({"text": ["ok"] * len(prompts), "token_count": [2] * len(prompts)})

    p = Pipeline(points=coll, config=PipelineConfig(generate=GenerateConfig(model=flaky)))
    req = spark.createDataFrame([("a", "please fail", {}, [1.0, 1.0, 1.0]), ("b", "fine", {}, [1.0, 1.0, 1.0])],
                                "event_id string, user_query string, metadata map<string,string>, qvec array<float>")
    state, _ = p.run(req)
    got = {r.event_id: r for r in state.collect()}
    assert got["b"].response == "ok" and got["b"].token_count == 2
    assert got["a"].response.startswith(K.NO_MODEL_REFERENCES_PREFIX)
    assert got["a"].errors[-1].error_type == "RuntimeError" and got["a"].errors[-1].stage == K.GENERATE


def test_missing_redaction_map_fails_before_running(spark):
    import pytest

    from qaflow.config import RedactionConfig
    from qaflow.functions.text import SecurityServiceError
    coll = _collection(spark, [(1, "123text1", "NZ", None)])
    with pytest.raises(SecurityServiceError):
        Pipeline(points=coll, config=PipelineConfig(redaction=RedactionConfig(redaction_map=None))).build()


def test_cache_hit_jumps_to_generate(spark):
    from qaflow.operators.retrieve import CONTEXTS_TYPE
    coll = _collection(spark, [(1, "123text1", "NZ", None)])
    cache = spark.createDataFrame([(9, [1.0, 1.0, 1.0], "q", [(1, "c9", "cached text\n", 1.0, None, None, False)],
                                    "old", None)],
                                  f"cache_id long, cvec array<float>, user_query string, contexts {CONTEXTS_TYPE.simpleString()}, "
                                  "response string, ts timestamp_ntz")
    p = Pipeline(points=coll, cache=cache, stages=["SECURITY", "RCACHE", "RETRIEVE", "CONSOLIDATE", "GENERATE", "WCACHE"])
    r = p.run(_requests(spark))[0].first()
    assert r.cache_hit and [c.doc_id for c in r.contexts] == ["c9"] and r.m_relevant_document_ids_scores is None


def test_metadata_without_title_takes_the_error_path(spark):
    arts = spark.createDataFrame([(1, "123text1")], "doc_id long, text string")
    coll = A.build_collection(arts, lambda t: digit_encode(t, 3)) \
        .withColumn("payload", F.create_map(F.lit("url"), F.lit("u1")))
    p = Pipeline(points=coll, stages=["RETRIEVE", "CONSOLIDATE", "GENERATE"])
    r = p.run(_requests(spark))[0].first()
    assert r.errors[0].stage == K.RETRIEVE and r.errors[0].error_type == "KeyError"
    assert r.m_relevant_document_ids_scores == "1:6.000000"
    # the other-error fallback goes on to CONSOLIDATE (formatted there), then GENERATE
    assert r.contexts[0].text == K.OTHER_ERROR_PREFIX + K.FALLBACK_TAIL + "\n"


def test_pipeline_answers_do_not_depend_on_the_plan(spark):
    from qaflow.config import RetrievalConfig
    from qaflow.sources import tables as TB
    from tests.conftest import SF_SMALL
    pts, qs = TB.collection_points(spark, SF_SMALL), TB.questions(spark, SF_SMALL)
    default, _ = Pipeline(points=pts, filter_keys=["label"]).run(qs)
    # tiny budgets: a grid of many cells, and hits that are not broadcast
    tiny = PipelineConfig(retrieval=RetrievalConfig(max_broadcast_bytes=100, block_bytes=4_000))
    blocks, _ = Pipeline(points=pts, config=tiny, filter_keys=["label"]).run(qs)
    a = {r.event_id: (r.response, r.m_prompt) for r in default.collect()}
    b = {r.event_id: (r.response, r.m_prompt) for r in blocks.collect()}
    assert a == b and len(a) == qs.count()


def test_the_encoder_sees_each_row_once(spark):
    import numpy as np

    from qaflow.functions.vectors import model_encoder

    seen = spark.sparkContext.accumulator(0)

    class Model:
        def encode(self, texts):
            seen.add(len(texts))
            return np.array([[float(len(t)), 1.0, 0.0] for t in texts])

    coll = _collection(spark, [(i, f"{100 + i}text", "NZ", None) for i in range(5)])
    rows = [(f"e{i}", f"question {i}", {}, None if i % 3 else [1.0, 2.0, 3.0]) for i in range(30)] + [("gone", None, {}, None)]
    req = spark.createDataFrame(rows, "event_id string, user_query string, metadata map<string,string>, qvec array<float>").repartition(3)
    state, _ = Pipeline(points=coll, encoder=model_encoder(Model, 3)).run(req)
    got = {r.event_id: r for r in state.collect()}
    assert seen.value == 20  # 10 bring a vector, one has no text
    assert len(got) == 31 and all(len(got[f"e{i}"].contexts) > 0 for i in range(30)) and got["gone"].response is None


def test_rows_that_do_not_search_are_spread(spark):
    from qaflow.operators import retrieve as R

    df = spark.range(2000).select(F.col("id").cast("string").alias("event_id"), F.lit("q").alias("user_query"), F.array(F.lit(1.0)).alias("qvec"))
    keys = df.select(R.state_key(F.col("event_id") == "7", R.search_key("qvec", None)).alias("k"), R.search_key("qvec", None).alias("s"))
    assert keys.where("k = s").count() == 1 and keys.select("k").distinct().count() > 1900


def test_further_redaction_kinds(spark):
    import pytest

    from qaflow.config import RedactionConfig
    from qaflow.functions.text import SecurityServiceError

    coll = _collection(spark, [(1, "123text1", "NZ", None)])
    tokens = dict(K.REDACTION_TOKENS)

    def cleaned(**kinds):
        p = Pipeline(points=coll, config=PipelineConfig(redaction=RedactionConfig(**kinds)), stages=["SECURITY"])
        req = spark.createDataFrame([("e", "mail me at ann@example.org, card 1111 2222 3333 4444", {}, None)], "event_id string, user_query string, metadata map<string,string>, qvec array<float>")
        return p.run(req)[0].first().user_query

    mail = {"Mail": r"\S+@\S+\.\w+"}
    assert cleaned(redaction_map=tokens | {"Mail": "<$mail>"}, patterns=mail) == "mail me at <$mail>, card <REDACTED: Financial information>"
    with pytest.raises(SecurityServiceError):
        cleaned(redaction_map=tokens, patterns=mail)  # a pattern without a token
    with pytest.raises(SecurityServiceError):
        cleaned(redaction_map=tokens | {"Mail": "x"})  # a token without a pattern


def test_ranking_svm_stage(spark):
    import numpy as np

    from qaflow.config import RerankConfig, RetrievalConfig
    from qaflow.operators import rerank as RR

    rnd = np.random.RandomState(4)
    vectors = rnd.normal(size=(60, 4))
    hits = spark.createDataFrame([(f"e{i % 12}", vectors[i].tolist(), float(vectors[i, 2] > 0)) for i in range(60)] + [("lone", [9.0, 9.0, 9.0, 9.0], 0.0)],
                                 "event_id string, vector array<double>, relevance double")
    pairs = RR.pair_differences(hits).collect()
    want = sum(2 * sum(vectors[i, 2] > 0 for i in range(e, 60, 12)) * sum(vectors[i, 2] <= 0 for i in range(e, 60, 12)) for e in range(12))
    assert len(pairs) == want and sum(r.label for r in pairs) == want / 2
    w = RR.fit_ranking_svm(hits)
    assert np.argmax(np.abs(w)) == 2 and w[2] > 0
    pts = spark.createDataFrame([(i, vectors[i].tolist(), str(i), f"text {i}") for i in range(60)], "id long, vector array<double>, doc_id string, text string")
    cfg = PipelineConfig(retrieval=RetrievalConfig(top_k=8), rerank=RerankConfig(top_k=3))
    req = spark.createDataFrame([("q", "hello", {}, [1.0, 0.0, 0.0, 0.0]), ("bad", "hello", {}, [1.0])], "event_id string, user_query string, metadata map<string,string>, qvec array<double>")
    got = {r.event_id: r for r in Pipeline(points=pts, config=cfg, rerank_weights=w, stages=["RETRIEVE", "RERANK"]).run(req)[0].collect()}
    found = sorted(range(60), key=lambda i: -vectors[i, 0])[:8]
    best = sorted(found, key=lambda i: -float(vectors[i] @ np.array(w)))[:3]
    assert [(c.rank, c.doc_id) for c in got["q"].contexts] == [(k + 1, str(i)) for k, i in enumerate(best)]
    assert got["bad"].errors[0].error_type == K.SEARCH_ARGUMENTS_ERROR and len(got["bad"].contexts) == 1
