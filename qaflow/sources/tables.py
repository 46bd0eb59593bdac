"""Driver tables and the RAG inputs Spark derives from them.

* collection points: ``embeddings`` (vectors, ``label``) joined with ``documents``
  (text, ``lang``, ``source``) on ``vec_id = doc_id``; a page of ``pages`` with the
  same id gives the point ``title`` (from ``<title>``) and ``url`` -- only those
  points carry context metadata.
* questions: every ``embeddings`` row is a question (its vector is the query
  vector) whose text is built from the ``orders`` row with the same key; some texts
  carry a spaced 16-digit card number (positive redaction case), others an
  unspaced one (must stay). Metadata ``{"label": <label>}`` is the must-filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, listed anew at each call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    return F.when(t != "", t)


def collection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point table: id, vector, doc_id, text, label, lang, source, title, url, payload."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), "url", page_title(F.col("html")).alias("ptitle"))
    j = (e.join(d, e.vec_id == d.doc_id, "inner")
         .join(p, F.col("vec_id") == F.col("page_id"), "left"))
    has_page = F.col("page_id").isNotNull()
    title = F.when(has_page, F.coalesce(F.col("ptitle"), F.concat(F.lit("Title: "), F.col("doc_id").cast("string"))))
    payload = F.when(has_page, F.create_map(F.lit("title"), title, F.lit("url"), F.col("url"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    return j.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
        F.col("doc_id").cast("string").alias("doc_id"), "text", "label", "lang", "source",
        title.alias("title"), F.when(has_page, F.col("url")).alias("url"), payload.alias("payload"),
    )


def card_number(o: DataFrame) -> Column:
    """A 16-digit number derived from the order row, as text."""
    digits = F.lpad((F.col("o_orderkey") * F.lit(7919) + F.col("o_custkey")).cast("string"), 16, "0")
    return digits


def spaced(digits: Column) -> Column:
    return F.concat_ws(" ", F.substring(digits, 1, 4), F.substring(digits, 5, 4),
                       F.substring(digits, 9, 4), F.substring(digits, 13, 4))


def question_text(o: DataFrame) -> Column:
    digits = card_number(o)
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    paid = F.when(F.col("o_orderstatus") == "F",
                  F.concat(F.lit("My card number is "), spaced(digits), F.lit(". ")))
    ref = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Reference "), digits, F.lit(". ")))
    return F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was placed on "), day, F.lit(". "),
        F.coalesce(paid, F.lit("")), F.coalesce(ref, F.lit("")),
        F.lit("What is the status of my "), F.lower(F.col("o_orderpriority")), F.lit(" order?"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows: event_id, user_query, metadata (JSON literals), qvec."""
    e = table(spark, sf_dir, "embeddings")
    o = table(spark, sf_dir, "orders")
    j = e.join(o, e.vec_id == o.o_orderkey, "left")
    text = F.coalesce(question_text(o), F.concat(F.lit("What is document "), F.col("vec_id").cast("string"),
                                                  F.lit(" about?")))
    return j.select(
        F.concat(F.lit("q"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("event_id"),
        text.alias("user_query"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding").alias("qvec"),
    )


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as requests without vectors (the encoder makes them)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("event_id"),
        F.col("text").alias("user_query"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
