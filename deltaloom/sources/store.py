"""Versioned tables on shared storage: a base in buckets by key, small folders of later changes, and one manifest per committed batch.

A table's base is one folder of parquet; of a table with many buckets, hashes of its bucketing columns, it has a partition for
each, while one with few is always read whole and written where its rows are made. A batch writes only what it changes, as a folder of whole rows and of keys that are gone, so its cost follows the changes and
not the table. Reading lays the changes over the base. Change folders are merged once they are many, and
once they hold a set share of the base's bytes all is written anew, so that a byte of changes costs a bounded number of
bytes in the long run. A batch that is known to change so much goes into the new base at once. Nothing that a manifest names is ever overwritten, and a new manifest is written beside the
old ones and renamed, so a batch is applied as a whole or not at all, and a lost executor or driver leaves at most
files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row's bucket; whether its key is gone; the number of the folder of changes that it stands in.
BUCKET, GONE, AT = "__b", "__gone", "__at"
#: The share of the base's bytes (and the least bytes) of changes from which a table is written anew, and the most folders of changes.
SHARE, LEAST_BYTES, MOST_DELTAS = 0.25, 32 << 20, 12
#: Tables of so many buckets at most are read whole: a batch touches nearly all of them anyway.
FEW_BUCKETS = 32
#: Bytes of a row group in a base without partitions, so that few files can still be read by many tasks.
ROW_GROUP = 32 << 20


@dataclass(frozen=True)
class Entry:
    """What a manifest knows of a table."""

    name: str
    schema: str  # JSON
    key: tuple[str, ...]
    bucket_by: tuple[str, ...]
    buckets: int
    base: str = ""  # folder of the rows as last written whole; without one there are none
    size: int = 0  # its bytes
    rows: int = 0  # and its rows; 0 if it is small
    deltas: tuple[tuple[str, int], ...] = ()  # folders of later changes, the oldest first, and their bytes
    top: int = 0  # number of the last folder of changes
    adds: bool = False  # rows of one key add up, in the base and in changes, instead of the last one counting

    @property
    def folders(self) -> list[str]:
        return [x for x in (self.base, *[d for d, _ in self.deltas]) if x]

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Files:
    """Small text files on whatever storage Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """Write under another name and rename; False if ``name`` is there already."""
        draft, final = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return int(self.fs.getContentSummary(self.path(name)).getLength())


def bucket_of(columns: Iterable[str], n: int) -> Column:
    """The bucket of a row; NULLs hash like any value."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(n)).cast("int")


def same_key(left: str, right: str, key: Iterable[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in key])


def nullable(schema: T.StructType) -> T.StructType:
    """The same columns, all of which may be NULL, as they are once read from files."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark, self.root)

    # manifests

    def latest(self) -> dict | None:
        names = [n for n in self.files.list("manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifest/{names[-1]}")) if names else None

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` the latest. Fails if another writer has committed that number."""
        if not self.files.write(f"manifest/{manifest['number']:012d}.json", json.dumps(manifest)):
            raise RuntimeError(f"manifest {manifest['number']} was committed by another writer")

    def entry(self, manifest: dict, name: str) -> Entry | None:
        found = manifest["tables"].get(name)
        return Entry(**{**found, "key": tuple(found["key"]), "bucket_by": tuple(found["bucket_by"]), "deltas": tuple(map(tuple, found["deltas"]))}) if found else None

    @staticmethod
    def put(manifest: dict, e: Entry) -> None:
        manifest["tables"][e.name] = asdict(e)

    # tables

    def empty(self, name: str, schema: T.StructType, key: Iterable[str], bucket_by: Iterable[str] | None = None, buckets: int | None = None) -> Entry:
        return Entry(name, json.dumps(nullable(schema).jsonValue()), tuple(key), tuple(bucket_by or key), buckets or self.buckets)

    def read(self, e: Entry, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of all or some buckets."""
        rows = self._base(e, buckets)
        if not e.deltas:
            return rows
        if e.adds:
            return rows.unionByName(self._changes(e, buckets).select(*self._names(e)))
        return self._over(e, rows, self._latest(e, buckets))

    def _over(self, e: Entry, rows: DataFrame, late: DataFrame) -> DataFrame:
        """Changes laid over rows."""
        return self._without(e, rows, late).unionByName(late.filter(f"NOT {GONE}").select(*self._names(e)))

    @staticmethod
    def _without(e: Entry, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of no key in ``keys``."""
        return rows.alias("o").join(keys.select(*[f"`{k}`" for k in e.key]).alias("k"), same_key("o", "k", e.key), "left_anti").select("o.*")

    @staticmethod
    def _names(e: Entry) -> list[str]:
        return [f"`{f.name}`" for f in e.struct]

    def _base(self, e: Entry, buckets: Iterable[int] | None) -> DataFrame:
        if not e.base:
            return self.spark.createDataFrame([], e.struct)
        rows = self.spark.read.schema(T.StructType([*e.struct, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.root}/{e.base}")
        if buckets is not None:  # a filter on partitions: other folders are not opened
            rows = rows.filter(F.col(BUCKET).isin(list(buckets)))
        return rows.select(*self._names(e))

    def _changes(self, e: Entry, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows of the folders of changes, with GONE, AT and BUCKET."""
        marks = [T.StructField(GONE, T.BooleanType()), T.StructField(AT, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        rows = self.spark.read.schema(T.StructType([*e.struct, *marks])).parquet(*[f"{self.root}/{d}" for d, _ in e.deltas])
        return rows if buckets is None else rows.filter(F.col(BUCKET).isin(list(buckets)))

    def _latest(self, e: Entry, buckets: Iterable[int] | None = None) -> DataFrame:
        """The last change of every key that has changed since the base was written: its row, or that it is GONE."""
        rows = self._changes(e, buckets)
        if len(e.deltas) == 1:
            return rows.drop(AT, BUCKET)
        row = F.struct(*[f"`{f.name}`" for f in e.struct if f.name not in e.key], GONE)
        last = rows.groupBy(*[f"`{k}`" for k in e.key]).agg(F.max_by(row, AT).alias("r"))
        return last.select(*[F.col(f"`{f.name}`" if f.name in e.key else f"r.`{f.name}`") for f in e.struct], f"r.{GONE}")

    def _folder(self, e: Entry) -> str:
        return f"data/{e.name.replace('.', '/')}/{uuid.uuid4().hex}"

    @staticmethod
    def _cast(e: Entry) -> list[Column]:
        return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in e.struct]

    def write(self, e: Entry, rows: DataFrame) -> Entry:
        """The table with ``rows`` as a new base."""
        folder = self._folder(e)
        placed = rows.select(*self._cast(e)).withColumn(BUCKET, bucket_of(e.bucket_by, e.buckets))
        if e.buckets > FEW_BUCKETS:
            placed = placed.repartitionById(e.buckets, F.col(BUCKET)).sortWithinPartitions(BUCKET, *[f"`{k}`" for k in e.key])  # a task for each bucket
            placed.write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        else:
            placed.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{folder}")
        e = replace(e, base=folder, size=self.files.size(folder), deltas=(), top=0)
        return replace(e, rows=self._base(e, None).count() if e.size > LEAST_BYTES else 0)  # from the files' footers

    @staticmethod
    def much(e: Entry, n: int) -> bool:
        """Whether about ``n`` more changes, each of the bytes of a row, would have the table written anew."""
        return e.rows > 0 and n * e.size / e.rows + sum(b for _, b in e.deltas) > max(LEAST_BYTES, SHARE * e.size)

    @staticmethod
    def counted(e: Entry, kept: DataFrame) -> int:
        """How many rows are kept, if a table is so large that it depends on it how they are written; else 0."""
        return kept.count() if e.size + sum(b for _, b in e.deltas) > LEAST_BYTES else 0

    def change(self, e: Entry, changed: DataFrame, n: int = 0) -> Entry:
        """The table after changes: whole rows, or keys that are GONE (a column of ``changed``), each key once at most.

        ``n`` says about how many they are, if that is known and ``changed`` may be computed twice.
        """
        if self.much(e, n):
            return self.write(e, self._over(e, self.read(e), changed))
        e = self._appended(e, changed)
        if sum(n for _, n in e.deltas) > max(LEAST_BYTES, SHARE * e.size):
            return self.write(e, self.read(e))
        return self._merged(e, self._latest(e)) if len(e.deltas) > MOST_DELTAS else e

    def add(self, e: Entry, rows: DataFrame, summed: Callable[[DataFrame], DataFrame]) -> Entry:
        """The table after rows that add to what it holds, which is not read; ``summed`` adds up the rows of each key."""
        e = self._appended(e, rows.withColumn(GONE, F.lit(False)))
        if sum(n for _, n in e.deltas) > max(LEAST_BYTES, SHARE * e.size):
            return self.write(e, summed(self.read(e)))
        return self._merged(e, summed(self._changes(e).select(*self._names(e))).withColumn(GONE, F.lit(False))) if len(e.deltas) > MOST_DELTAS else e

    def _appended(self, e: Entry, changed: DataFrame) -> Entry:
        folder = self._folder(e)
        rows = changed.select(*self._cast(e), GONE, F.lit(e.top + 1).cast("bigint").alias(AT), bucket_of(e.bucket_by, e.buckets).alias(BUCKET))
        (rows.sortWithinPartitions(BUCKET) if e.buckets > FEW_BUCKETS else rows).write.parquet(f"{self.root}/{folder}")
        return replace(e, deltas=(*e.deltas, (folder, self.files.size(folder))), top=e.top + 1)

    def _merged(self, e: Entry, late: DataFrame) -> Entry:
        """The table with one folder of changes."""
        folder = self._folder(e)
        merged = late.withColumns({AT: F.lit(e.top).cast("bigint"), BUCKET: bucket_of(e.bucket_by, e.buckets)})
        merged.sortWithinPartitions(BUCKET).write.parquet(f"{self.root}/{folder}")
        return replace(e, deltas=((folder, self.files.size(folder)),))

    def touched(self, e: Entry, changed: DataFrame) -> list[int] | None:
        """Buckets of the keys in ``changed``, one number for each bucket at most; None, which is all, of a table with few."""
        if e.buckets <= FEW_BUCKETS:
            return None
        return sorted(r[0] for r in changed.select(bucket_of(e.bucket_by, e.buckets).alias(BUCKET)).distinct().collect())

    def upsert(self, e: Entry, keys: DataFrame, rows: DataFrame, failed: str | None = None, n: int = 0) -> tuple[Entry, int]:
        """Replace the rows of all ``keys``, each of them once, by ``rows``, whose keys are among them. ``n`` says about how many keys there are, if that is known.

        Keys whose row has a value in the column ``failed`` keep what they have; returns their number, too, counted while the rest is written.
        """
        if self.much(e, n):
            n_failed = 0
            if failed is not None:
                bad = rows.filter(F.col(failed).isNotNull())
                if n_failed := bad.count():
                    keys = self._without(e, keys, bad)
                rows = rows.filter(F.col(failed).isNull())
            return self.write(e, self._without(e, self.read(e), keys).unionByName(rows.select(*self._names(e)))), n_failed
        found = rows.select(*self._names(e), F.lit(False).alias(GONE), *([F.col(failed).isNotNull().alias("__failed")] if failed else []))
        both = keys.alias("k").join(found.alias("r"), same_key("k", "r", e.key), "left")
        columns = [F.col(f"{'k' if f.name in e.key else 'r'}.`{f.name}`") for f in e.struct]
        gone = F.coalesce(F.col(f"r.{GONE}"), F.lit(True)).alias(GONE)
        if failed is None:
            return self.change(e, both.select(*columns, gone)), 0
        seen = Observation()
        marked = both.select(*columns, gone, F.coalesce("r.__failed", F.lit(False)).alias("__failed")).observe(seen, F.count(F.when(F.col("__failed"), 1)).alias("n"))
        return self.change(e, marked.filter("NOT __failed").drop("__failed")), seen.get["n"]

    def changed(self, e: Entry, keys: DataFrame, rows: DataFrame) -> DataFrame:
        """(old, new) structs of what ``upsert`` changes, from the entry before it."""
        old = self.read(e, self.touched(e, keys)).alias("o").join(keys.alias("k"), same_key("o", "k", e.key), "left_semi")
        return feed(e, old, rows)


def feed(e: Entry, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new) structs of rows that differ between two sets of rows with e's columns and key."""
    names = [f.name for f in e.struct]
    a = old.select(F.struct(*[f"`{n}`" for n in names]).alias("old"))
    b = new.select(F.struct(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in e.struct]).alias("new"))
    on = reduce(lambda x, y: x & y, [F.col(f"old.`{k}`").eqNullSafe(F.col(f"new.`{k}`")) for k in e.key])
    return a.join(b, on, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
