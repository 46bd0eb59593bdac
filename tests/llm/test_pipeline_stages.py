"""Each stage against what its operator says about its own input; the whole run at the smallest scale."""

import corpus_pipeline as cp

from qaflow.llm import decontaminate
from qaflow.llm.common import saved, table
from tests.conftest import SF_SMALL


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = saved(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.scan(docs, table(spark, SF_SMALL, "benchmark")).filter("contaminated").collect()}
            assert before - after == bad
        docs = out
    last = cp.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_edges(spark):
    """Nulls in any column, empty texts, repeated rows, columns of clashing names, and an empty table."""
    rows = [(1, "the first text of some words here", "en", "s", 5), (1, "the first text of some words here", "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0),
            (None, "a text whose id is not known to anyone", None, "s", None), (None, None, None, None, None), (6, "  \n\t", "fr", "s", 4), (7, "word " * 3000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("node", "_new", "_lines", "_id", "hit_spans", "rid", "key"):
        docs = docs.withColumn(name, docs["lang"])
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in cp.STAGES[:-1]:
            kept = saved(stage(spark, kept, SF_SMALL), f"edges-{name}")
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        out = cp.STAGES[-1][1](spark, kept, SF_SMALL)
        assert out.count() == kept.count()
        if table is docs:
            # one of the two equal rows goes; null and blank texts are linked with nothing
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "7", "None", "None"]
        else:
            assert kept.count() == 0
