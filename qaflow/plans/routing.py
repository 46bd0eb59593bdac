"""Stage routing as row-level column logic.

Every request row carries ``sentinel`` (the stage that must run next; END = NULL)
and ``errors`` (``array<struct<stage, error_type, message>>``). A stage only
changes rows whose sentinel equals its number; everything else passes through
unchanged -- one pass over the rows, no split and union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

ERROR_TYPE = T.StructType([
    T.StructField("stage", T.IntegerType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("message", T.StringType()),
])
ERRORS_TYPE = T.ArrayType(ERROR_TYPE)
GATE = "_gate"


def increment(sentinel: Column) -> Column:
    """Next stage number; past the last stage or from END -> END (NULL)."""
    return F.when(sentinel.isNull() | (sentinel >= K.LAST_STAGE), F.lit(None).cast("int")) \
        .otherwise(sentinel + 1).cast("int")


def append_error(errors: Column, condition: Column, stage: int, error_type: Column | str,
                 message: Column | str) -> Column:
    """Push ``(stage, type, message)`` when ``condition`` holds."""
    et = F.lit(error_type) if isinstance(error_type, str) else error_type
    msg = F.lit(message) if isinstance(message, str) else message
    entry = F.struct(F.lit(stage).alias("stage"), et.cast("string").alias("error_type"),
                     msg.cast("string").alias("message"))
    return F.when(condition, F.concat(errors, F.array(entry))).otherwise(errors)


def empty_errors() -> Column:
    return F.array().cast(ERRORS_TYPE)


def start(df: DataFrame, first_stage: int) -> DataFrame:
    """Initial routing columns (the first configured stage runs first)."""
    return df.withColumns({"sentinel": F.lit(first_stage).cast("int"), "errors": empty_errors()})


@dataclass
class Stage:
    """K1: a stage = number + ``apply(state, next_stage) -> state`` on gated rows.

    ``apply`` reads the boolean column ``_gate`` (sentinel == this stage) and must set
    ``sentinel`` only where the gate holds.
    """

    stage: int
    apply: Callable[[DataFrame, int | None], DataFrame]

    @property
    def name(self) -> str:
        return K.STAGE_NAMES[self.stage]


def links(stages: list[Stage], linked: bool = True) -> list[int | None]:
    """Next stage per position: the following configured stage (END after the last),
    or with ``linked=False`` the plain successor number."""
    if not linked:
        return [None if s.stage >= K.LAST_STAGE else s.stage + 1 for s in stages]
    return [stages[i + 1].stage for i in range(len(stages) - 1)] + [None]


def run_stages(state: DataFrame, stages: list[Stage], linked: bool = True,
               after_stage: Callable[[Stage, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fold the stages over the state; a stage runs only where ``sentinel == stage``."""
    for st, nxt in zip(stages, links(stages, linked)):
        state = state.withColumn(GATE, F.coalesce(F.col("sentinel") == F.lit(st.stage), F.lit(False)))
        state = st.apply(state, nxt).drop(GATE)
        if after_stage is not None:
            state = after_stage(st, state)
    return state


def gated(state: DataFrame, values: dict[str, Column], sentinel: Column | None = None) -> DataFrame:
    """Set columns only on gated rows, in one projection (all values read the input row)."""
    gate = F.col(GATE)
    present = set(state.columns)
    cols = {c: F.when(gate, v).otherwise(F.col(c)) if c in present else F.when(gate, v)
            for c, v in values.items()}
    if sentinel is not None:
        cols["sentinel"] = F.when(gate, sentinel.cast("int")).otherwise(F.col("sentinel"))
    return state.withColumns(cols) if cols else state


def next_or_end(nxt: int | None) -> Column:
    return F.lit(nxt).cast("int")


# ---------------------------------------------------------------------- trace stages

def visited(stage: int) -> str:
    """What a trace stage leaves behind a text."""
    return f"|{stage}"


def trace_stage(stage: int, text_col: str = "text") -> Stage:
    """A stage that leaves its number behind the text, to see which rows it ran on."""

    def apply(state: DataFrame, nxt):
        return gated(state, {text_col: F.concat(F.col(text_col), F.lit(visited(stage)))}, next_or_end(nxt))

    return Stage(stage, apply)


def trace_cache_stage(hit: Callable[[Column], Column], text_col: str = "text") -> Stage:
    """I4: an RCACHE that only routes: to GENERATE on a hit, else to the successor."""

    def apply(state: DataFrame, nxt):
        return gated(state, {}, F.when(hit(F.col(text_col)), F.lit(K.GENERATE)).otherwise(increment(F.col("sentinel"))))

    return Stage(K.RCACHE, apply)


def all_trace_stages(text_col: str = "text") -> list[Stage]:
    return [trace_stage(s, text_col) for s in range(0, K.LAST_STAGE + 1)]
