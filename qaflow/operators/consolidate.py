"""Fit contexts into a token budget.

Rule per event (contexts in strategy order, lengths of the *formatted* text):
greedily add while ``total + len <= token_limit``. Let ``i`` be the first context
that does not fit and ``n`` the number of contexts:

* no such ``i``      -> keep all, formatted, in strategy order;
* ``i`` is the last  -> keep the ones before it (n = 1 gives an empty list, no error);
* ``i`` is earlier   -> error ``AllDocumentsExceedContextWindowError``; the contexts
  pass on in retrieval order, the ones placed before ``i`` already formatted.

Two forms: :func:`consolidate_array` on an ``array<struct>`` column of one event row (higher-order
functions, no shuffle), used by the pipeline, and :func:`consolidate_long` on one-row-per-context tables, which
gathers the few contexts of an event and does the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_tokens, format_context


def _overflow_piece(doc_id: Column, ntok: Column) -> Column:
    return F.concat(F.lit("(i='"), doc_id, F.lit("' length="), ntok.cast("string"), F.lit(")"))


def consolidate_long(contexts: DataFrame, strategy: str = "simple", token_limit: int = 1000,
                     token_counter=char_tokens, key: str = "event_id") -> DataFrame:
    """Long form: ``(key, rank, doc_id, text, score, title, url, has_meta)`` ->
    ``(key, pos, rank, doc_id, text, error)`` with ``pos`` the 0-based output order.

    An event has few contexts, so they are gathered once (one shuffle), consolidated in the row and laid out again.
    """
    fields = ["rank", "doc_id", "text", "score", "title", "url", "has_meta"]
    per = contexts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_ctx"))
    done = per.select(key, consolidate_array(F.col("_ctx"), strategy, token_limit, token_counter).alias("_r"))
    laid = done.select(key, F.posexplode("_r.contexts").alias("pos", "_c"), F.col("_r.error").alias("error"))
    return laid.select(key, F.col("pos").cast("int").alias("pos"), "_c.rank", "_c.doc_id", "_c.text", "error")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def consolidate_array(ctx: Column, strategy: str = "simple", token_limit: int = 1000,
                      token_counter=char_tokens) -> Column:
    """Array form on ``array<struct<rank, doc_id, text, score, title, url, has_meta>>``.

    Returns ``struct<contexts: array<same struct>, error: string>``. Each context is
    formatted once, the array is sorted once and walked once (``aggregate``); the
    intermediate arrays are bound with a one-element ``transform`` so nothing is
    recomputed per reference.
    """

    def clean(x, text):
        return F.struct(x["rank"].alias("rank"), x["doc_id"].alias("doc_id"), text.alias("text"),
                        x["score"].alias("score"), x["title"].alias("title"), x["url"].alias("url"),
                        x["has_meta"].alias("has_meta"))

    def cmp(a, b):
        if strategy == "score_weighted":
            first = F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
        elif strategy == "simple":
            first = F.when(a["_flen"] < b["_flen"], -1).when(a["_flen"] > b["_flen"], 1).otherwise(0)
        else:
            first = F.lit(0)
        return F.when(first != 0, first).otherwise(
            F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))

    formatted = F.transform(ctx, lambda x: x.withField(
        "_fmt", format_context(x["text"], x["title"], x["url"], x["has_meta"])))
    with_len = F.transform(formatted, lambda x: x.withField("_flen", F.length(x["_fmt"]))
                           .withField("_ntok", token_counter(x["_fmt"]).cast("long")))

    def body(w):
        empty_ctx = F.slice(F.transform(w, lambda x: clean(x, x["_fmt"])), 1, 0)
        acc0 = F.struct(empty_ctx.alias("kept"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("fo"),
                        F.lit(0).alias("i"))

        def step(acc, x):
            i = acc["i"] + 1
            fits = (acc["fo"] == 0) & (acc["total"] + x["_ntok"] <= token_limit)
            return F.struct(
                F.when(fits, F.concat(acc["kept"], F.array(clean(x, x["_fmt"])))).otherwise(acc["kept"]).alias("kept"),
                F.when(fits, acc["total"] + x["_ntok"]).otherwise(acc["total"]).alias("total"),
                F.when((acc["fo"] == 0) & ~fits, i).otherwise(acc["fo"]).alias("fo"),
                i.alias("i"))

        def finish(r):
            n = r["i"]
            fo = r["fo"]
            placed = F.transform(r["kept"], lambda c: c["rank"])
            passthrough = F.transform(w, lambda x: clean(
                x, F.when(F.array_contains(placed, x["rank"]), x["_fmt"]).otherwise(x["text"])))
            is_error = (fo > 0) & (fo < n)
            # only events that overflow write their pieces
            pieces = F.transform(F.array_sort(w, cmp), lambda x: _overflow_piece(x["doc_id"], x["_ntok"]))
            msg = F.concat(F.lit(f"token_limit={token_limit} Documents: "), F.array_join(pieces, ","))
            return F.struct(F.when(is_error, passthrough).otherwise(r["kept"]).alias("contexts"),
                            F.when(is_error, msg).alias("error"))

        return F.aggregate(F.array_sort(w, cmp), acc0, step, finish)

    return _let(with_len, body)

