"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of text that a Python worker handles at once; bounds its memory.
SLICE_CHARS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, one of our own on a single machine; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to reliable shared storage, so that later reads neither recompute it nor need the executors that made it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(sizes: Iterable[int], most: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of about ``most`` characters each; a longer text gets a slice of its own."""
    start = total = n = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total, n = total + size, i + 1
    if n > start:
        yield slice(start, n)


def texts_of(column) -> list[str]:
    """Arrow or pandas column of texts as a list, null as the empty text."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return [v if isinstance(v, str) else "" for v in values]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unused_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, with underscores until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def add_fields(df: DataFrame, struct: Column, fields: list[str], prefix: str = "") -> DataFrame:
    """``df`` with the fields of a struct, computed once, as columns; columns of their names (after ``prefix``) are replaced, all others stay."""
    got = unused(df, "m_got")
    return df.withColumn(got, struct).withColumns({prefix + f: F.col(f"`{got}`.{f}") for f in fields}).drop(got)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(rows: DataFrame, fields: str, compute: Callable[[list[str]], list[tuple]]) -> DataFrame:
    """``rows``, whose last column is a text (null: empty), with ``fields`` (DDL) in that column's place.

    ``compute`` gets texts of about SLICE_CHARS characters together and returns a tuple for each. All other columns pass as
    Arrow, unseen, so that an integer beside nulls never becomes a float.
    """
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*rows.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in made]
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            for part in slices(map(len, texts)):
                got = compute(texts[part])
                kept = batch.slice(part.start, part.stop - part.start).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[i] for r in got], t) for i, t in enumerate(types)]], schema.names)

    return rows.mapInArrow(run, schema)


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row. Maps count by their JSON, and which columns are null counts too."""
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns]), *hashed)
