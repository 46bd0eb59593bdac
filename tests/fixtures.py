"""Small inputs: eight points made by a rule, contexts and questions."""

import numpy as np
from pyspark.sql import functions as F

from qaflow.operators.retrieve import CONTEXTS_TYPE

# eight points: id, vector, part (1 to 3), kind (ids 1 to 5 fruit, 6 to 8 metal)
POINTS = [(i, np.random.RandomState(100 + i).rand(4).round(3).tolist(), (i - 1) % 3 + 1, "fruit" if i < 6 else "metal") for i in range(1, 9)]
QUERY = [0.7, 0.3, 0.2, 0.5]


def points_df(spark):
    df = spark.createDataFrame(POINTS, "id long, vector array<float>, part long, kind string")
    return df.withColumn("doc_id", F.col("id").cast("string")) \
        .withColumn("text", F.concat_ws(" ", F.col("kind"), F.lit("sample no."), F.col("id")))


def query_df(spark, n=1):
    return spark.createDataFrame([(f"e{i}", QUERY) for i in range(n)], "event_id string, qvec array<float>")


def contexts_df(spark, rows):
    """rows: (event_id, [(rank, doc_id, text, score, title, url, has_meta), ...])"""
    return spark.createDataFrame(rows, f"event_id string, contexts {CONTEXTS_TYPE.simpleString()}")


def plain(doc_id, text, rank, score=None):
    return (rank, doc_id, text, score, None, None, False)


def meta(doc_id, text, rank, title, url, score=None):
    return (rank, doc_id, text, score, title, url, True)
