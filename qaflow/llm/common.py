"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A blank with no white space on either side: every GPT-2 style pattern ends a match before it, whatever stands around.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = re.compile(r"\s\s")


def safe_words(text: str) -> list[str]:
    """The stretches between safe cuts; all but the first have lost their leading blank."""
    if _SPACES.search(text) or text[:1] == " " or text[-1:] == " ":
        return SAFE_CUT.split(text)
    return text.split(" ")  # every blank is a safe cut: the quick way


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch, so that a batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col):
    """A-Z only, as the contracts of the word operators ask."""
    return F.translate(col, UPPER, LOWER)


def byte_slices(batch: pa.RecordBatch, col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, in slices of about ``limit`` bytes of one column, so that what is made of them stays small however long the texts are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, at + 10_000)
        yield batch.slice(at, stop - at)
        at = stop


def free(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that no column of a table has (upper and lower case count as one)."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
