"""GENERATE: prompt (H8, H9), model call (K3, H10), no-model answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import build_prompt, strip_prompt  # noqa: F401  (strip_prompt re-exported)


def context_text(contexts: Column) -> Column:
    """Context texts joined in order (the array is kept in order)."""
    return F.array_join(F.transform(contexts, lambda c: F.coalesce(c["text"], F.lit(""))), "")


def references_text(contexts: Column) -> Column:
    """``"{i}. {title}: {url}\\n"`` or ``"{i}. {doc_id}\\n"`` per context, 0-based."""
    lines = F.transform(contexts, lambda c, i: F.concat(
        i.cast("string"), F.lit(". "),
        F.when(c["has_meta"], F.concat(c["title"], F.lit(": "), c["url"])).otherwise(c["doc_id"]),
        F.lit("\n")))
    return F.array_join(lines, "")


def fallback_answer(contexts: Column, strategy: str = "references") -> Column:
    """G3 (references) or G4 (documents)."""
    if strategy == "documents":
        return F.concat(F.lit(K.NO_MODEL_DOCUMENTS_PREFIX), context_text(contexts))
    return F.concat(F.lit(K.NO_MODEL_REFERENCES_PREFIX), references_text(contexts))


def prompt_for(user_query: Column, contexts: Column, template: str = "basic", eos: str = K.EOS_TOKEN) -> Column:
    return build_prompt(user_query, context_text(contexts), template, eos)


MODEL_RESULT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


def _result_rows(model, prompts: pd.Series) -> list[tuple]:
    """Call the model on a batch; a failing batch is halved until the failing rows stand alone,
    so one bad prompt costs a logarithmic number of extra calls, not one per row."""
    try:
        res = model(prompts)
        texts, counts = list(res["text"]), list(res["token_count"])
        if len(texts) != len(prompts):
            raise ValueError(f"the model returned {len(texts)} rows for {len(prompts)} prompts")
        return [(t, c, None, None) for t, c in zip(texts, counts)]
    except Exception as e:  # noqa: BLE001 - a failing row becomes an error entry
        if len(prompts) == 1:
            return [(None, None, type(e).__name__, str(e))]
    half = len(prompts) // 2
    parts = (prompts.iloc[:half], prompts.iloc[half:])
    return [row for part in parts for row in _result_rows(model, part.reset_index(drop=True))]


def _call_rows(model, prompts: pd.Series) -> pd.DataFrame:
    columns = ["text", "token_count", "error_type", "error_message"]
    return pd.DataFrame(_result_rows(model, prompts), columns=columns, dtype=object)


def _answered(model, prompts: pd.Series) -> pd.DataFrame:
    """The result of every prompt; a null one is not passed to the model and has none."""
    live = prompts.notna().to_numpy()
    res = pd.DataFrame({f.name: None for f in MODEL_RESULT.fields}, index=prompts.index, dtype=object)
    if live.any():
        res.loc[live, :] = _call_rows(model, prompts[live].reset_index(drop=True)).to_numpy(dtype=object)
    res["token_count"] = pd.array(res["token_count"].tolist(), dtype="Int32")
    return res


# prompts that a model sees at once
MODEL_ROWS = 1000


def call_model(df: DataFrame, model, prompt_col: str = "prompt", out_col: str = "llm") -> DataFrame:
    """K3: ``model(pandas.Series[str]) -> DataFrame{text, token_count}`` run in Arrow batches.

    Row errors become ``error_type``/``error_message``; they never fail the job.
    Without a model every row reports ``ModelUnavailableError``.
    """
    if model is None:
        return df.withColumn(out_col, F.struct(
            F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("token_count"),
            F.lit("ModelUnavailableError").alias("error_type"),
            F.lit("no language model configured").alias("error_message")))

    @F.pandas_udf(MODEL_RESULT)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        active = None
        for batch in batches:
            if active is None:  # a factory builds the model once per task, then serves every batch
                active = model.build() if isinstance(model, ModelFactory) else model
            parts = [_answered(active, batch.iloc[at:at + MODEL_ROWS].reset_index(drop=True)) for at in range(0, len(batch), MODEL_ROWS)]
            yield pd.concat(parts, ignore_index=True) if parts else _answered(active, batch)

    from ..session import spread_for_cpu

    # only the prompts go to Python, not the contexts beside them; not deterministic: it is called once for a row, wherever its result is used
    return spread_for_cpu(df).withColumn(out_col, call.asNondeterministic()(F.col(prompt_col)))


class ModelFactory:
    """Wrap ``factory() -> callable`` so a heavy model is loaded once per task, not per batch."""

    def __init__(self, factory):
        self.factory = factory

    def build(self):
        return self.factory()


def echo_model(answer: str = "The answer is 42.", max_length: int | None = None):
    """A deterministic stand-in model that echoes its prompt like a causal LM,
    then strips the echo (H10); token count = characters, capped at ``max_length``."""

    def model(prompts: pd.Series) -> pd.DataFrame:
        gen = prompts + answer
        text = [g[len(p) - 1:] for g, p in zip(gen, prompts)]
        tc = [len(g) if max_length is None else min(len(g), max_length) for g in gen]
        return pd.DataFrame({"text": text, "token_count": tc})

    return model
