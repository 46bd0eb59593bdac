"""A1: files that hold one large JSON array (or objects one after another), read in parallel.

Spark reads such a file in one task, because the border of an object cannot be seen from the middle of a file. Here the text
reader splits it as any other, with ``}`` for the end of a line, and the borders are found in two passes:

1. every block tells, for either case (it begins inside a string or not), where it ends and by how many braces
   the depth has changed: one small row for each block, which are put together in the order of the file;
2. every block then knows its state at its first byte, and cuts its objects; the pieces of an object that lies over several
   blocks are joined (at most one such object begins in a block).

Objects keep all their keys. An object that is not valid JSON is a row whose ``item`` is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialised

ESCAPE = re.compile(r"\\.", re.DOTALL)
# blocks whose states are sent to all tasks (some 60 bytes each)
BLOCKS = 500_000


def _steps(value: str, inside: bool, depth: int) -> tuple[bool, int]:
    """State after a piece of text that a closing brace follows."""
    parts = ESCAPE.sub("", value).split('"')
    depth += sum(p.count("{") for p in parts[int(inside)::2])
    inside ^= len(parts) % 2 == 0
    return inside, depth if inside else max(depth - 1, 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    rows = (r for b in batches for r in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist()))
    for key, run in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in run)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each of its two possible beginnings: the end, the change of depth and the lowest depth on the way."""
    for (path, block), values in _runs(batches):
        inside, depth, low = [False, True], [0, 0], [0, 0]
        for value in values:
            parts = ESCAPE.sub("", value).split('"')
            for k in (0, 1):
                depth[k] += sum(p.count("{") for p in parts[int(inside[k])::2])
                inside[k] ^= len(parts) % 2 == 0
                if not inside[k]:
                    depth[k] -= 1
                    low[k] = min(low[k], depth[k])
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "inside": [inside], "depth": [depth], "low": [low]})


def _prefix(table: pa.Table) -> pa.Table:
    """The state at the beginning of every block of a file."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    inside, depth, out = False, 0, []
    for r in rows:
        out.append((r["path"], r["block"], inside, depth))
        k = int(inside)
        # a closing brace outside of all objects (the one that the reader takes for the last line's end) counts nothing
        depth = max(depth + r["depth"][k], r["depth"][k] - r["low"][k])
        inside = r["inside"][k]
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("path", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64())))})


WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, idx, item``: every object of the files as text, ``idx`` its number in the block in which it begins."""
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = lines.mapInArrow(_summary, "path string, block bigint, inside array<boolean>, depth array<bigint>, low array<bigint>")
    begins = materialised(ends.groupBy("path").applyInArrow(_prefix, "path string, block bigint, inside boolean, depth bigint"), "json-blocks")
    n = begins.count()
    if n > BLOCKS:
        raise ValueError(f"{n} blocks: raise spark.sql.files.maxPartitionBytes until they are {BLOCKS} at most")
    state = spark.sparkContext.broadcast({(r["path"], r["block"]): (r["inside"], r["depth"]) for r in begins.collect()})  # at most BLOCKS rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), values in _runs(batches):
            inside, depth = state.value[path, block]
            carried, held, idx, out = depth > 0, [], 0, []
            for value in values:
                before = depth
                was_inside = inside
                inside, depth = _steps(value, inside, depth)
                if before == 0:
                    # outside of objects: drop what stands before the first brace
                    at = value.find("{")
                    if was_inside or at < 0:
                        continue
                    value = value[at:]
                held.append(value + "}")
                if depth == 0 and not inside:
                    out.append((idx, HEAD if carried else WHOLE, "".join(held)))
                    idx += not carried
                    carried, held = False, []
                if len(out) >= 1000:
                    yield _pieces(path, block, out)
                    out = []
            if held:
                out.append((idx, MIDDLE if carried else TAIL, "".join(held)))
            if out:
                yield _pieces(path, block, out)

    pieces = materialised(lines.mapInArrow(cut, "path string, block bigint, idx bigint, kind int, item string"), "json-objects")
    # at most two pieces of a block belong to objects over several blocks
    order = Window.partitionBy("path").orderBy("block", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("first", F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(order))
    joined = parts.groupBy("path", "first").agg(
        F.max(F.when(F.col("kind") == TAIL, F.col("idx"))).alias("idx"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "item"))), lambda x: x["item"]), "").alias("item"))
    return pieces.where(F.col("kind") == WHOLE).select("path", "block", "idx", "item").unionByName(joined.select("path", F.col("first").alias("block"), "idx", "item"))


def _pieces(path: str, block: int, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(out)), pa.array([block] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()),
                                       pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out])], names=["path", "block", "idx", "kind", "item"])


def payload_of(item: Column, without: tuple = ("doc_id", "text")) -> Column:
    """All other keys of an object as a map: texts as they are, other values as JSON, nested ones included; nulls are left out."""
    values = F.try_variant_get(item, "$", "map<string,variant>")
    kept = F.map_filter(values, lambda k, v: ~k.isin(*without) & ~F.is_variant_null(v) & v.isNotNull())
    return F.transform_values(kept, lambda _k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def read_articles_array(spark: SparkSession, path: str) -> DataFrame:
    """A1: articles of JSON array files: ``path, block, idx`` (their order), ``doc_id, text, title, url``, and ``payload`` with every other key."""
    item = F.try_parse_json("item")
    rows = read_json_array(spark, path).withColumn("item", item)

    def field(name: str) -> Column:
        return F.try_variant_get(F.col("item"), f"$.{name}", "string").alias(name)

    return rows.select("path", "block", "idx", *map(field, ("doc_id", "text", "title", "url")), payload_of(F.col("item")).alias("payload"), F.col("item").isNotNull().alias("valid"))


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Every partition as one file that holds one JSON array (the column ``item`` has the objects)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = []
            for item in batch.column("item").to_pylist():
                out.append(("[" if first else ",") + item)
                first = False
            yield pa.RecordBatch.from_pydict({"value": out})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    rows.select("item").mapInArrow(lines, "value string").write.text(path)
