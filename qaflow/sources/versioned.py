"""A keyed Parquet table with versions: appends, patches and deletes that are merged on read, and compaction.

Plain Parquet takes no UPDATE or DELETE. Here a change of a few rows writes a few rows:

``base/v=N/<parts>``     rows as they were written by version N (create, append, compact)
``changes/v=N/<parts>``  the last change of each key in version N: a row, or a tombstone
``commits/``             one JSON row for each version; a version exists once its row does

Both folders are partitioned by ``v`` and by columns made of the key (hash buckets, a day), so a read with a condition
on these columns, and the choice of live versions, are partition filters of the scan. A reader takes the base rows that
no later change names, and the last change of each key unless it is a tombstone; the two sides agree in their
partitions, and without changes there is no join at all. ``compact`` rewrites the partitions that have changes and no
others; ``vacuum`` then removes what they replaced. A version that a failed job left without its commit is never
read, and is overwritten by the next attempt. There is one writer at a time: a second commit of one number raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_removed

COMMIT = "version long, kind string, batch string, parts array<array<string>>"


class CommitConflict(RuntimeError):
    """Two writers committed the same version."""


@dataclass(frozen=True)
class Part:
    """A partition column: its name, its type and the expression that makes it of the key."""

    name: str
    type: T.DataType
    of: Callable[[Column], Column]


def bucket(n: int) -> Part:
    return Part("bucket", T.IntegerType(), lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, parts: list[Part]) -> None:
        self.spark, self.root, self.schema, self.key, self.parts = spark, root.rstrip("/"), schema, key, parts
        self.names = [p.name for p in parts]
        self.full = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType()),
                                  T.StructField("v", T.LongType()), *[T.StructField(p.name, p.type) for p in parts]])

    # ---------------------------------------------------------------- versions

    def commits(self, version: int | None = None) -> list:
        """The commits up to ``version``, in order: one small row for each."""
        try:
            rows = self.spark.read.schema(COMMIT).json(f"{self.root}/commits")
        except Exception as e:  # noqa: BLE001 - only a folder that is not there
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((r for r in rows.collect() if version is None or r["version"] <= version), key=lambda r: r["version"])

    def version(self) -> int:
        """The newest version, -1 before the first."""
        got = self.commits()
        return got[-1]["version"] if got else -1

    def _commit(self, version: int, kind: str, batch: str | None, parts: list[list[str]]) -> int:
        row = self.spark.createDataFrame([(version, kind, batch, parts)], COMMIT)
        row.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        if sum(c["version"] == version for c in self.commits()) > 1:
            raise CommitConflict(f"version {version} of {self.root} was committed twice")
        return version

    def _write(self, rows: DataFrame, folder: str, kind: str, batch: str | None, touched: list[list[str]] | None = None) -> int:
        commits = self.commits()
        if batch is not None and any(c["batch"] == batch for c in commits):
            return commits[-1]["version"]  # a replay
        version = commits[-1]["version"] + 1 if commits else 0
        path = f"{self.root}/{folder}/v={version}"
        rows = rows.withColumns({p.name: p.of(F.col(self.key)).cast(p.type) for p in self.parts})
        # full partitions are split over tasks and small ones put together, whatever the sizes of the keys
        with shuffles_removed(self.spark):
            rows.hint("rebalance", *self.names).write.mode("overwrite").partitionBy(*self.names).parquet(path)
        return self._commit(version, kind, batch, self._written(path) if touched is None else touched)

    def _written(self, path: str) -> list[list[str]]:
        """The partitions of a version, from the names of its files."""
        found = set()
        for name in self.spark.read.schema(self.schema).parquet(path).inputFiles():
            at = dict(x.split("=", 1) for x in name.split("/") if "=" in x)
            found.add(tuple(unquote(at[n]) for n in self.names))
        return [list(p) for p in sorted(found)]

    # ---------------------------------------------------------------- reading

    def _scan(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.full).parquet(f"{self.root}/{folder}")

    def _in(self, parts: list[list[str]]) -> Column:
        """The partitions of a list, as conditions on the partition columns."""
        groups: dict[tuple, list[str]] = {}
        for p in parts:
            groups.setdefault(tuple(p[:-1]), []).append(p[-1])
        last = self.parts[-1]
        out = []
        for head, values in groups.items():
            tests = [F.col(p.name) == F.lit(x).cast(p.type) for p, x in zip(self.parts, head)]
            tests.append(F.col(last.name).isin([F.lit(x).cast(last.type) for x in sorted(values)]))
            out.append(reduce(lambda a, b: a & b, tests))
        return reduce(lambda a, b: a | b, out) if out else F.lit(False)

    def _live(self, commits: list, kinds: tuple) -> Column:
        """The rows of committed versions that no later compaction has replaced."""
        versions = [c["version"] for c in commits if c["kind"] in kinds]
        live = F.col("v").isin(versions) if versions else F.lit(False)
        newest: dict[tuple, int] = {}
        for c in commits:
            if c["kind"] == "compact":
                newest.update({tuple(p): c["version"] for p in c["parts"]})
        for version in sorted(set(newest.values())):
            own = self._in([list(p) for p, v in newest.items() if v == version])
            live = live & (~own | (F.col("v") >= version))
        return live

    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a version (the newest without one); ``where`` is a condition on the partition columns."""
        commits = self.commits(version)
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        if version is not None and any(c["kind"] == "vacuum" and c["version"] > version for c in self.commits()):
            raise ValueError(f"version {version} of {self.root} was removed by vacuum")
        columns = self.schema.fieldNames()
        written = any(c["kind"] in ("base", "compact") for c in commits)
        base = self._scan("base").where(self._live(commits, ("base", "compact"))) if written else self.spark.createDataFrame([], self.full)
        if where is not None:
            base = base.where(where)
        if not self._changed(commits):
            return base.select(*columns)
        last = self._last(commits, where)
        if not written:
            return last.where(~F.col("_deleted")).select(*columns)
        marks = last.select(F.col(self.key).alias("_key"), F.col("v").alias("_cv"))
        kept = base.join(marks, (F.col(self.key) == F.col("_key")) & (F.col("_cv") > F.col("v")), "left_anti")
        return kept.select(*columns).unionByName(last.where(~F.col("_deleted")).select(*columns))

    def _changed(self, commits: list) -> list[list[str]]:
        """The partitions with live changes."""
        dirty: dict[tuple, bool] = {}
        for c in commits:
            if c["kind"] in ("changes", "compact"):
                dirty.update({tuple(p): c["kind"] == "changes" for p in c["parts"]})
        return [list(p) for p, d in dirty.items() if d]

    def _last(self, commits: list, where: Column | None) -> DataFrame:
        """The last change of each key: combined in the tasks before the shuffle."""
        rows = self._scan("changes").where(self._live(commits, ("changes",)))
        rows = rows if where is None else rows.where(where)
        others = [c for c in self.schema.fieldNames() if c != self.key]
        if sum(c["kind"] == "changes" for c in commits) == 1:  # one version has a key once: nothing to combine, and columns that are not asked for are not read
            return rows.select(self.key, *others, "v", "_deleted")
        picked = F.max(F.struct("v", "_seq", "_deleted", *others)).alias("m")
        return rows.groupBy(self.key).agg(picked).select(self.key, *[F.col(f"m.{c}").alias(c) for c in others], F.col("m.v").alias("v"), F.col("m._deleted").alias("_deleted"))

    def of_keys(self, keys: list) -> Column:
        """The partitions that hold some keys, as a condition for ``read``."""
        tests = [reduce(lambda a, b: a & b, [F.col(p.name).eqNullSafe(p.of(F.lit(k)).cast(p.type)) for p in self.parts]) for k in keys]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    # ---------------------------------------------------------------- writing

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """New rows as they are; keys may repeat (a log). The first append creates the table."""
        none = {"_seq": F.lit(None).cast("long"), "_deleted": F.lit(None).cast("boolean")}
        return self._write(rows.select(*self.schema.fieldNames()).withColumns(none), "base", "base", batch)

    def patch(self, rows: DataFrame, deleted: Column, order: Column | None = None, batch: str | None = None) -> int:
        """Insert or replace rows by their key, or delete the keys for which ``deleted`` holds. Of several changes of a key the last one counts (``order``, then the other columns)."""
        others = [c for c in self.schema.fieldNames() if c != self.key]
        seq = (F.lit(0) if order is None else order).cast("long")
        marked = rows.where(F.col(self.key).isNotNull()).withColumns({"_seq": seq, "_deleted": F.coalesce(deleted, F.lit(False))})
        last = marked.groupBy(self.key).agg(F.max(F.struct("_seq", *others, "_deleted")).alias("m"))
        last = last.select(self.key, *[F.col(f"m.{c}").alias(c) for c in [*others, "_seq", "_deleted"]])
        return self._write(last, "changes", "changes", batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        """Tombstones for all rows so far of some keys; ``keys`` has the key column."""
        none = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name != self.key}
        rows = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumns(none)
        return self._write(rows.withColumns({"_seq": F.lit(None).cast("long"), "_deleted": F.lit(True)}), "changes", "changes", batch)

    def compact(self) -> int:
        """Rewrite the partitions that have live changes, and no others; nothing to do gives the version as it is."""
        commits = self.commits()
        touched = self._changed(commits)
        if not touched:
            return commits[-1]["version"] if commits else -1
        none = {"_seq": F.lit(None).cast("long"), "_deleted": F.lit(None).cast("boolean")}
        rows = self.read(where=self._in(touched)).withColumns(none)
        return self._write(rows, "base", "compact", None, touched)

    def vacuum(self) -> int:
        """Remove the files that compactions have replaced; versions before the last one can no longer be read. Returns the folders removed."""
        commits = self.commits()
        newest: dict[tuple, int] = {}
        for c in commits:
            if c["kind"] == "compact":
                newest.update({tuple(p): c["version"] for p in c["parts"]})
        old = [(folder, c["version"], p) for c in commits for folder, kinds in (("base", ("base", "compact")), ("changes", ("changes",))) if c["kind"] in kinds
               for p in c["parts"] if c["version"] < newest.get(tuple(p), -1)]
        if not old:
            return 0
        self._commit(commits[-1]["version"] + 1, "vacuum", None, [])
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        removed = 0
        for folder, v, p in old:
            path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, folder, f"v={v}", *[f"{n}={x}" for n, x in zip(self.names, p)]]))
            removed += bool(path.getFileSystem(conf).delete(path, True))
        return removed
