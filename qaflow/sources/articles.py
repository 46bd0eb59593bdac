"""Article ingest and maintenance.

:class:`ArticleStore` keeps the articles as a versioned table in hash buckets: a patch writes the patched rows
only and is merged on read; compaction rewrites the buckets that it touched. :func:`apply_patch` is the same
semantics on two DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised, spread_for_cpu
from .versioned import VersionedTable, bucket

ARTICLE_JSON_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
])

ARTICLE_TYPE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
])


def read_articles_json(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_JSON_SCHEMA,
                       array_file: bool = True) -> DataFrame:
    """A1: a JSON file holding a list of article objects (or JSON lines)."""
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def with_defaults(articles: DataFrame) -> DataFrame:
    """B2: ``doc_id`` is required (``valid`` flag for quarantine); missing title -> ``Title: {doc_id}``."""
    return articles.withColumn("valid", F.col("doc_id").isNotNull()) \
        .withColumn("title", F.coalesce(F.col("title"), F.concat(F.lit("Title: "), F.col("doc_id").cast("string"))))


def trim_articles(articles: DataFrame, order_col: str, head: int = 700, max_chars: int = 1000) -> DataFrame:
    """First ``head`` articles in file order, then text shorter than ``max_chars``
    (a missing text has length 0, so it stays)."""
    first = articles.orderBy(F.col(order_col).asc()).limit(head)
    return first.where(F.coalesce(F.length("text"), F.lit(0)) < max_chars)


def with_positions(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """0 to n-1 in the order of some columns, without a task that sees all rows: ranges are counted, then numbered from
    what stands before them. The rows are written once, so that both passes see the same ranges."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = materialised(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def build_collection(articles: DataFrame, encoder, key: str = "doc_id", text: str = "text", spread: bool = False,
                     order: list[str] | None = None) -> DataFrame:
    """A2: point per article: id = 0-based position (in the order of the columns ``order``, or of the key), vector =
    encoder(text), payload = every other column of the item as text, nulls left out."""
    order = order or [key]
    payload_cols = [c for c in articles.columns if c not in (key, *order)]
    numbered = with_positions(articles, order, "_id")
    out = (spread_for_cpu(numbered) if spread else numbered).select(
        F.col("_id").alias("id"), encoder(F.col(text)).alias("vector"),
        F.col(key).cast("string").alias("doc_id"), *[F.col(c) for c in payload_cols if c != "doc_id"])
    if "payload" in articles.columns:
        return out
    kept = [c for c in payload_cols if c not in (text, "doc_id") and isinstance(articles.schema[c].dataType, T.AtomicType)]
    entries = [x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]
    whole = F.map_filter(F.create_map(*entries), lambda _k, v: v.isNotNull()) if entries else F.create_map()
    return out.withColumn("payload", whole.cast("map<string,string>"))


def last_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The row with the highest ``order_col`` per key, as an aggregate.

    ``max(struct(order_col, other columns...))`` is combined map-side, so a key that
    holds a third of all rows is reduced inside each task before the shuffle instead of
    landing in one task; ties on ``order_col`` are broken by the other columns, so a
    recomputed partition (after an executor loss) picks the same row.
    """
    others = [c for c in df.columns if c not in (key, order_col)]
    picked = F.max(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_last")
    return df.groupBy(key).agg(picked).select(key, *[F.col(f"_last.{c}").alias(c) for c in [order_col] + others])


def load_points(points: DataFrame, order_col: str, key: str = "id") -> DataFrame:
    """A3: upsert points by their own id (last occurrence wins); payload without text."""
    last = last_per_key(points, key, order_col)
    return last.drop(order_col, *(["text"] if "text" in points.columns else []))


def apply_patch(current: DataFrame, patch: DataFrame, key: str = "doc_id", order_col: str = "seq") -> DataFrame:
    """Insert new keys, update existing ones, delete when text is NULL or ''.

    Duplicate keys inside a patch: the last one (``order_col``) wins, chosen by a
    map-side-combined aggregate. The current table is only anti-joined (one shuffle
    per side on ``key``), no driver work.
    """
    last = last_per_key(patch, key, order_col).drop(order_col)
    keep = current.join(last.select(key), key, "left_anti")
    upserts = last.where(F.col("text").isNotNull() & (F.col("text") != ""))
    return keep.unionByName(upserts.select(*current.columns))


def get_articles(articles: DataFrame, ids: DataFrame | str, key: str = "doc_id") -> DataFrame:
    """Point lookup, or many ids at once with a semi join."""
    cols = [c for c in ARTICLE_TYPE.fieldNames() if c in articles.columns]
    if isinstance(ids, str):
        return articles.where(F.col(key) == F.lit(ids)).select(*cols)
    # distinct first (map-side combined): a hot id repeated many times is not shuffled as such
    return articles.join(ids.select(F.col(key)).distinct(), key, "left_semi").select(*cols)


class ArticleStore(VersionedTable):
    """Articles by ``doc_id``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        super().__init__(spark, root, ARTICLE_TYPE, "doc_id", [bucket(buckets)])

    def apply(self, patch: DataFrame, order_col: str = "seq", batch: str | None = None) -> int:
        """Insert new ids, replace existing ones, delete those without text; the last one of an id wins."""
        return self.patch(patch, F.coalesce(F.col("text"), F.lit("")) == "", F.col(order_col), batch)

    def get(self, ids: list[str] | DataFrame) -> DataFrame:
        """Articles by id; a list of ids reads their buckets only."""
        if isinstance(ids, DataFrame):
            return get_articles(self.read(), ids)
        return self.read(where=self.of_keys(ids)).where(F.col("doc_id").isin(ids))


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Article table from ``documents``: doc_id as text, created_by = source."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text",
                            F.col("source").alias("created_by"),
                            F.lit(None).cast("timestamp").alias("created_date"))


def patch_from_labels(documents: DataFrame, labels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A patch feed derived from the tables: toxic documents are deleted (empty text),
    documents of good quality are re-sent with a review mark, and every
    benchmark item is a new article. Quality updates come after deletions."""
    lab = labels.join(documents.select("doc_id", "text", "source"), "doc_id", "inner")
    deletes = lab.where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("text"),
        F.lit("moderation").alias("created_by"), F.lit(None).cast("timestamp").alias("created_date"),
        F.lit(1).alias("seq"))
    updates = lab.where(F.col("quality") == 1).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("[reviewed] "), F.col("text")).alias("text"),
        F.col("source").alias("created_by"), F.lit(None).cast("timestamp").alias("created_date"),
        F.lit(2).alias("seq"))
    inserts = benchmark.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("doc_id"), "text",
        F.lit("benchmark").alias("created_by"), F.lit(None).cast("timestamp").alias("created_date"),
        F.lit(3).alias("seq"))
    return deletes.unionByName(updates).unionByName(inserts)
