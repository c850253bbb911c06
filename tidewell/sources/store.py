"""Keyed tables on plain Parquet, and SQL over them.

A table is hash buckets of its key, each a list of folders with Parquet files, and a
manifest that says which folders hold which bucket. A change reads the buckets that its
keys fall into, writes those anew beside the old ones and puts the next manifest in
place by a rename, so readers see the table before or after it and a failed write
leaves no trace in it. Buckets without a changed key are neither read nor written. A
second writer fails when it puts its manifest in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.scan import RANGE_ROWS, filled, scanned
from tidewell.schemas import TABLES

#: Buckets of a new table; ``rebucket`` changes their number as it grows.
BUCKETS = 16
#: Folders of one bucket from which an insert puts them together.
MOST_PARTS = 8


def merged(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """``stored`` with ``incoming`` rows put in by key; of several for a key the last by ``order`` wins."""
    columns = stored.columns
    place = F.col(order) if order else F.monotonically_increasing_id()
    new = incoming.withColumn("_place", place).withColumn("_new", F.lit(1)).select(*columns, "_new", "_place")
    old = stored.select(*columns, F.lit(0).alias("_new"), F.lit(0).cast(new.schema["_place"].dataType).alias("_place"))
    latest = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("_place"))
    return old.unionByName(new).withColumn("_k", F.row_number().over(latest)).where("_k = 1").select(*columns)


def with_new_keys(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``stored`` and those ``incoming`` rows whose key it lacks, the first of each."""
    fresh = incoming.join(stored.select(*key).distinct(), list(key), "left_anti").dropDuplicates(list(key))
    return stored.unionByName(fresh.select(*stored.columns))


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], on: str, values: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each left row with the last right row of its key at or before it, by one sorted pass over both.

    A key with very many rows is cut into ranges of time, see ``scan``.
    """
    other = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, on, *other, *(F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values), F.lit(1).alias("_side"))
    b = right.select(*by, on, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in other), *(F.col(v).alias(f"_v_{v}") for v in values), F.lit(0).alias("_side"))
    met = scanned(a.unionByName(b), {v: filled(F.col(f"_v_{v}")) for v in values}, by=by, order=[on, "_side"], rows=range_rows)
    return met.where("_side = 1").select(*by, on, *other, *values)


def run_sql(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame], args: Sequence | None = None) -> DataFrame:
    """``sql`` with ``frames`` as tables. SHOW TABLES gives their names as ``name``."""
    if " ".join(sql.strip().rstrip(";").lower().split()) == "show tables":
        return spark.createDataFrame([(n,) for n in sorted(frames)], "name string")
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=list(args)) if args else spark.sql(sql)


@dataclass(frozen=True)
class Manifest:
    """One version of a table: the folders of each bucket, below the table's own."""

    version: int
    buckets: int
    files: dict[int, list[str]] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f for parts in self.files.values() for f in parts}


class TableStore:
    """Tables ``{name: (schema, key)}`` under ``root``, any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[T.StructType, Sequence[str]]] = TABLES, buckets: int = BUCKETS) -> None:
        if buckets < 1:
            raise ValueError("a table needs at least one bucket")
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets

    def _fs(self):  # noqa: ANN202 - a JVM object
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202 - a JVM object
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _versions(self, name: str) -> list[int]:
        fs, folder = self._fs(), self._path(name)
        if not fs.exists(folder):
            return []
        files = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(f.split(".")[1]) for f in files if f.startswith("_manifest."))

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        """The current manifest, or that of a version; of a new table, version 0 without files."""
        if version is None:
            version = max(self._versions(name), default=0)
        if not version:
            return Manifest(0, self.buckets)
        stream = self._fs().open(self._path(name, f"_manifest.{version}.json"))
        said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return Manifest(version, said["buckets"], {int(k): v for k, v in said["files"].items()})

    def _commit(self, name: str, new: Manifest) -> None:
        """Put a manifest in place; fails if a second writer was first. Then free what only versions before the last hold."""
        fs, jvm = self._fs(), self.spark._jvm
        made = self._path(name, f"_new.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(json.dumps({"buckets": new.buckets, "files": new.files}).encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, self._path(name, f"_manifest.{new.version}.json"), options)
        except Exception:
            fs.delete(made, False)
            raise
        versions = self._versions(name)
        kept = {f for v in versions[-2:] for f in self.manifest(name, v).folders()}  # readers of the version before may still run
        for version in versions[:-2]:
            for folder in self.manifest(name, version).folders() - kept:
                fs.delete(self._path(name, folder), True)
            fs.delete(self._path(name, f"_manifest.{version}.json"), False)

    def _bucketed(self, name: str, rows: DataFrame, buckets: int, *extra: str) -> DataFrame:
        """``rows`` in the table's types, with ``_bucket``."""
        schema, key = self.tables[name]
        typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields), *extra)
        return typed.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))

    def _stored(self, name: str, at: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = [f for b, parts in sorted(at.files.items()) if buckets is None or b in buckets for f in parts]
        schema = self.tables[name][0]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def _save(self, name: str, rows: DataFrame, tasks: int) -> dict[int, list[str]]:
        """Write rows that have ``_bucket``; the new folder of each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition(tasks, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        made = [f.getPath().getName() for f in self._fs().listStatus(self._path(name, folder))]
        return {int(f.split("=")[1]): [f"{folder}/{f}"] for f in made if f.startswith("_bucket=")}

    def _replace(self, name: str, at: Manifest, touched: Sequence[int], rows: DataFrame) -> None:
        """The next version: ``rows``, with ``_bucket``, in the place of what the touched buckets hold."""
        new = self._save(name, rows, len(touched))
        left = {b: parts for b, parts in at.files.items() if b not in touched}
        self._commit(name, Manifest(at.version + 1, at.buckets, left | new))

    def _touched(self, rows: DataFrame) -> dict[int, int]:
        """How many rows fall into each bucket: a row a bucket comes to the driver."""
        return {r["_bucket"]: r["n"] for r in rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}

    def read(self, name: str) -> DataFrame:
        return self._stored(name, self.manifest(name))

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        """Insert or replace by key; the number of incoming rows. Of several for a key the last by ``order`` wins."""
        at, key = self.manifest(name), self.tables[name][1]
        place = F.col(order) if order else F.monotonically_increasing_id()
        rows = self._bucketed(name, rows.withColumn("_place", place), at.buckets, "_place").persist()  # counted and merged, but made once
        touched = self._touched(rows)
        if touched:
            old = self._bucketed(name, self._stored(name, at, touched), at.buckets).withColumns({"_place": F.lit(None).cast(rows.schema["_place"].dataType), "_new": F.lit(0)})
            both = old.unionByName(rows.withColumn("_new", F.lit(1))).repartition(len(touched), "_bucket")
            latest = Window.partitionBy("_bucket", *key).orderBy(F.desc("_new"), F.desc("_place"))
            self._replace(name, at, list(touched), both.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_new", "_place"))
        rows.unpersist()
        return sum(touched.values())

    def insert_ignore(self, name: str, rows: DataFrame) -> int:
        """Insert rows with new keys, the first of each; their number. They become one more folder of their buckets; nothing is rewritten."""
        at, key = self.manifest(name), list(self.tables[name][1])
        rows = self._bucketed(name, rows, at.buckets).persist()
        touched = self._touched(rows)
        fresh = rows.join(self._stored(name, at, touched).select(*key), key, "left_anti").dropDuplicates(key)
        new = self._save(name, fresh, len(touched)) if touched else {}
        rows.unpersist()
        if not new:
            return 0
        grown = Manifest(at.version + 1, at.buckets, at.files | {b: at.files.get(b, []) + parts for b, parts in new.items()})
        self._commit(name, grown)
        n = self._stored(name, Manifest(0, at.buckets, new)).count()  # from the files' own counts
        full = [b for b in new if len(grown.files[b]) >= MOST_PARTS]
        if full:
            self._replace(name, grown, full, self._bucketed(name, self._stored(name, grown, full), at.buckets))
        return n

    def update(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """``change`` the rows of the buckets that ``keys`` fall into; it must leave every row's key as it is."""
        at, (schema, key) = self.manifest(name), self.tables[name]
        typed = keys.select(*(F.col(c).cast(schema[c].dataType) for c in key))
        touched = self._touched(typed.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(at.buckets)).cast("int")))
        touched = [b for b in touched if b in at.files]
        if touched:
            self._replace(name, at, touched, self._bucketed(name, change(self._stored(name, at, touched)), at.buckets))

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> None:
        """The whole table changed, and dealt to another number of buckets if one is given."""
        at = self.manifest(name)
        n = buckets or at.buckets
        new = self._save(name, self._bucketed(name, change(self._stored(name, at)), n), n)
        self._commit(name, Manifest(at.version + 1, n, new))

    def rebucket(self, name: str, buckets: int) -> None:
        self.rewrite(name, lambda rows: rows, buckets)

    def vacuum(self, name: str) -> int:
        """Delete folders that no kept version holds, as writers that failed leave them; not while a writer runs. Their number."""
        fs, folder = self._fs(), self._path(name, "data")
        kept = {f.rsplit("/", 1)[0] for v in self._versions(name) for f in self.manifest(name, v).folders()}
        found = [f"data/{f.getPath().getName()}" for f in fs.listStatus(folder)] if fs.exists(folder) else []
        for gone in (stale := [f for f in found if f not in kept]):
            fs.delete(self._path(name, gone), True)
        return len(stale)

    def sql(self, query: str, args: Sequence | None = None) -> DataFrame:
        return run_sql(self.spark, query, {name: self.read(name) for name in self.tables}, args)


def run_query(spark: SparkSession, query: str, root: str | None = None, args: Sequence | None = None) -> list[dict]:
    """Rows of a query as dicts; with ``root`` its tables can be read."""
    df = TableStore(spark, root).sql(query, args) if root else run_sql(spark, query, {}, args)
    return [dict(zip(df.columns, row)) for row in df.collect()]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
