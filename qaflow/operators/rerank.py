"""K6: rerank retrieved contexts by a score; a ranking SVM learned from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rerank_long(contexts: DataFrame, score: Column, top_k: int | None = None, key: str = "event_id") -> DataFrame:
    """Renumber ``rank`` by ``score`` descending (old rank breaks ties); keep ``top_k``."""
    w = Window.partitionBy(key).orderBy(score.desc_nulls_last(), F.col("rank").asc())
    out = contexts.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def rerank_array(ctx: Column, scorer=None, top_k: int | None = None) -> Column:
    """Same on one event's ``contexts`` array; ``scorer(struct) -> Column``."""
    if scorer is not None:
        scored = F.transform(ctx, lambda c: F.struct(scorer(c).alias("s"), c.alias("c")))
        srt = F.array_sort(scored, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(
            F.when(a["c"]["rank"] < b["c"]["rank"], -1).when(a["c"]["rank"] > b["c"]["rank"], 1).otherwise(0)))
        ctx = F.transform(srt, lambda x, i: x["c"].withField("rank", (i + 1).cast("int")))
    if top_k is not None:
        ctx = F.slice(ctx, 1, top_k)
    return ctx


def fit_svm_scorer(points: DataFrame, labels: DataFrame, vector: str = "vector", point_id: str = "id",
                   label_col: str = "quality", max_iter: int = 50, reg: float = 0.01):
    """Train a linear SVM (MLlib, distributed) on labelled point vectors."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    train = points.join(labels, points[point_id] == labels["doc_id"], "inner") \
        .select(array_to_vector(F.col(vector)).alias("features"), F.col(label_col).cast("double").alias("label"))
    return LinearSVC(maxIter=max_iter, regParam=reg).fit(train)


def svm_margins(model, hits_with_vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Add ``margin`` = raw SVM score of the positive class for each hit."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(hits_with_vectors.withColumn("features", array_to_vector(F.col(vector))))
    return scored.withColumn("margin", vector_to_array(F.col("rawPrediction"))[1]) \
        .drop("features", "rawPrediction", "prediction")


def pair_differences(hits: DataFrame, key: str = "event_id", vector: str = "vector", relevance: str = "relevance") -> DataFrame:
    """``features, label``: for every two hits of one question with different relevance, the difference of their vectors
    (better less worse: 1) and its negative (0). A question has few hits, so its pairs are few; both sides are
    shuffled by the question once."""
    from pyspark.ml.functions import array_to_vector

    hit = F.struct(F.col(vector).cast("array<double>").alias("v"), F.col(relevance).cast("double").alias("r"))
    per = hits.where(F.col(vector).isNotNull() & F.col(relevance).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("h"))
    better = per.select(key, "h", F.explode("h").alias("a"))
    both = better.select(F.col("a"), F.explode(F.filter("h", lambda x: x["r"] < F.col("a.r"))).alias("b"))
    diff = F.zip_with(F.col("a.v"), F.col("b.v"), lambda x, y: x - y)
    signs = both.select(F.explode(F.array(F.struct(diff.alias("d"), F.lit(1.0).alias("label")), F.struct(F.transform(diff, lambda x: -x).alias("d"), F.lit(0.0).alias("label")))).alias("p"))
    return signs.select(array_to_vector("p.d").alias("features"), F.col("p.label").alias("label"))


def fit_ranking_svm(hits: DataFrame, key: str = "event_id", vector: str = "vector", relevance: str = "relevance",
                    max_iter: int = 30, reg: float = 0.01) -> list[float]:
    """Weights of a linear ranking: hinge loss on the differences of pairs, without an intercept. A hit's score is the dot
    product of its vector with them. Zeros if no question has hits of different relevance."""
    from pyspark.ml.classification import LinearSVC

    pairs = pair_differences(hits, key, vector, relevance)
    some = hits.where(F.size(vector) > 0).select(F.size(vector)).first()
    if some is None or pairs.isEmpty():
        return [0.0] * (some[0] if some else 0)
    return [float(w) for w in LinearSVC(maxIter=max_iter, regParam=reg, fitIntercept=False, standardization=False).fit(pairs).coefficients]


def rerank_by_weights(ctx: Column, vectors: Column, weights: list[float], top_k: int | None = None) -> Column:
    """One event's ``contexts`` by the dot product of their vectors (in the same order) with the weights; the old rank breaks ties."""
    from ..functions.vectors import dot

    w = F.array(*[F.lit(float(x)) for x in weights])
    scored = F.transform(F.arrays_zip(ctx.alias("c"), vectors.alias("v")), lambda x: F.struct((-F.coalesce(dot(x["v"], w), F.lit(float("-inf")))).alias("s"), x["c"]["rank"].alias("o"), x["c"].alias("c")))
    ranked = F.transform(F.array_sort(scored), lambda x, i: x["c"].withField("rank", (i + 1).cast("int")))
    return ranked if top_k is None else F.slice(ranked, 1, top_k)
