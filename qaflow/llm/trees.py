"""Reduce one small row of each task to a single one, in rounds of bounded fan-in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

FAN = 16


def reduced(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> bytes | None:
    """``parts``: ``at int, state binary``, a row for each task. States are merged ``FAN`` at a time, in the order of ``at``.

    The rows are written first, so that the rounds read the same states if an executor is lost; one row reaches the driver."""
    parts = saved(parts, name, compression="none")
    n = parts.count()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        state = merge(table.column("state").to_pylist())
        return pa.table({"at": pa.array([table.column("at")[0].as_py() // FAN], pa.int32()), "state": pa.array([state], pa.binary())})

    while n > 1:
        parts = parts.groupBy(F.expr(f"at div {FAN}")).applyInArrow(run, "at int, state binary")
        n = -(-n // FAN)
    row = parts.first()
    return bytes(row["state"]) if row else None
