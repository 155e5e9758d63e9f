"""The change log: one commit is a folder of parquet files by source, and a marker that makes it readable.

Markers are small JSON files named by position, so a Structured Streaming file source reads them in order and never sees
half a commit. Change rows keep their types, because each source has files of its own.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from deltaloom.sources.store import same_key
from deltaloom.streaming.engine import Engine

MARKER = "seq bigint, tables array<string>"


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Changes (op, old, new) that lead from one state of a table to another; rows that stay are left out."""
    names = [f"`{c}`" for c in old.columns]
    a, b = old.select(F.struct(*names).alias("old")), new.select(F.struct(*names).alias("new"))
    on = reduce(lambda x, y: x & y, [F.col(f"old.`{k}`").eqNullSafe(F.col(f"new.`{k}`")) for k in key])
    both = a.join(b, on, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(op.alias("op"), "old", "new")


def inserts(rows: DataFrame) -> DataFrame:
    image = F.struct(*[f"`{c}`" for c in rows.columns])
    return rows.select(F.lit("insert").alias("op"), F.when(F.lit(False), image).alias("old"), image.alias("new"))


def deletes(rows: DataFrame) -> DataFrame:
    image = F.struct(*[f"`{c}`" for c in rows.columns])
    return rows.select(F.lit("delete").alias("op"), image.alias("old"), F.when(F.lit(False), image).alias("new"))


def updates(rows: DataFrame, **fields) -> DataFrame:
    """Updates of ``rows`` that give ``fields`` new values (columns over the old row)."""
    old = F.struct(*[f"`{c}`" for c in rows.columns])
    new = F.struct(*[(fields[c].cast(rows.schema[c].dataType) if c in fields else F.col(f"`{c}`")).alias(c) for c in rows.columns])
    return rows.select(F.lit("update").alias("op"), old.alias("old"), new.alias("new"))


def truncate(rows: DataFrame) -> DataFrame:
    """One change that empties the table; ``rows`` gives the schema."""
    image = F.struct(*[f"`{c}`" for c in rows.columns])
    none = rows.limit(0).select(F.when(F.lit(False), image).alias("old"), F.when(F.lit(False), image).alias("new")).schema
    one = rows.sparkSession.range(1)
    return one.select(F.lit("truncate").alias("op"), *[F.lit(None).cast(none[c].dataType).alias(c) for c in ("old", "new")])


class ChangeLog:
    """Appends commits to an engine's log and drains them."""

    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.files, self.root = engine.store.files, f"{engine.store.root}/log"

    def append(self, changes: dict[str, DataFrame]) -> int:
        """Add one source commit, changes (op, old, new; change_id orders changes of one key) by source; returns its position.

        The position is claimed by the marker's rename; a writer that loses the race takes the next one.
        """
        seq = self.engine.watermark_token() + 1
        draft = f"data-{seq}-{id(changes):x}"
        for name, rows in changes.items():
            if "change_id" not in rows.columns:
                rows = rows.withColumn("change_id", F.monotonically_increasing_id())
            rows.write.parquet(f"{self.root}/{draft}/{name}")
        while not self.files.write(f"log/commits/{seq:015d}.json", json.dumps({"seq": seq, "tables": [f"{draft}/{n}" for n in changes]})):
            seq += 1
        return seq

    def apply(self, markers: list[tuple[int, list[str]]], batch_id: int | None = None) -> bool:
        """Apply some commits as one batch."""
        found: dict[str, list[DataFrame]] = {}
        for seq, paths in sorted(markers):
            for p in paths:
                rows = self.spark.read.parquet(f"{self.root}/{p}").withColumn("seq", F.lit(seq).cast("bigint"))
                found.setdefault(p.partition("/")[2], []).append(rows)
        changes = {n: reduce(DataFrame.unionByName, x) for n, x in found.items()}
        return self.engine.process(changes, batch_id, max(s for s, _ in markers)) if markers else False

    def pending(self) -> list[tuple[int, list[str]]]:
        """Commits after the engine's position."""
        after = self.engine.manifest["seq"]
        names = [n for n in self.files.list("log/commits") if n.endswith(".json") and int(n.removesuffix(".json")) > after]
        return [(x["seq"], x["tables"]) for x in (json.loads(self.files.read(f"log/commits/{n}")) for n in names)]

    def drain(self, most: int = 1000) -> int:
        """Apply all pending commits, ``most`` to a batch; returns the position reached."""
        while markers := self.pending()[:most]:
            self.apply(markers)
        return self.engine.manifest["seq"]

    def trim(self) -> int:
        """Delete commits that the engine has applied; returns how many."""
        done = self.engine.manifest["seq"]
        names = [n for n in self.files.list("log/commits") if n.endswith(".json") and int(n.removesuffix(".json")) <= done]
        for n in names:
            for p in json.loads(self.files.read(f"log/commits/{n}"))["tables"]:
                self.files.delete(f"log/{p}")
            self.files.delete(f"log/commits/{n}")
        return len(names)

    def stream(self, checkpoint: str, *, most: int = 1000, available_now: bool = False) -> StreamingQuery:
        """Drain the log by Structured Streaming. Its batch number makes a replayed batch a no-op; its markers are few and small."""
        self.files.fs.mkdirs(self.files.path("log/commits"))
        markers = self.spark.readStream.schema(MARKER).option("maxFilesPerTrigger", most).json(f"{self.root}/commits")

        def batch(rows: DataFrame, number: int) -> None:
            done = self.engine.manifest["seq"]
            self.apply([(r["seq"], r["tables"]) for r in rows.collect() if r["seq"] > done])

        writer = markers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="1 second").start()


__all__ = ["ChangeLog", "deletes", "inserts", "same_key", "snapshot_diff", "truncate", "updates"]
