"""The engine: statements in, change batches in, targets that equal a full recompute out.

One writer applies batches in order. Everything that a batch makes goes to new files; the batch holds from the moment its
manifest is there, and a batch number that the latest manifest has passed is skipped, so replays change nothing.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce, wraps

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.errors import EngineError, refuse
from deltaloom.operators import changes as delta
from deltaloom.operators.full import ERROR, JoinPlan, can_fail, full, full_state, key_types, row_image, rows_of
from deltaloom.operators.partials import N, SIGN, Partials
from deltaloom.plans import types as S
from deltaloom.plans.definition import Checked, Relation, check
from deltaloom.plans.nodes import Alter, Col, Lifecycle, Transform, quote_table
from deltaloom.plans.parser import GRAMMAR, parse, split_statements
from deltaloom.plans.render import target_select_sql
from deltaloom.sources.store import GONE, Entry, Store, feed, nullable, same_key

WAITING, BACKFILLING, CATCHING_UP, LIVE, QUARANTINED, PAUSED = "waiting_to_backfill", "backfilling", "catching_up", "live", "quarantined", "paused"
#: Failures of one column, or held keys of a transform, from which it is stopped.
FUSE = 5
#: Rows of a source for which one bucket is made; a batch rewrites whole buckets, and a task writes one.
BUCKET_ROWS = 2_000_000
#: Upper bounds of the latency histograms, in seconds.
LATENCIES = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60)
POISON = "__poison"
POISON_SCHEMA = T.StructType([*[T.StructField(n, T.StringType()) for n in ("transform", "src_table", "key", "field", "state")], T.StructField("seq", T.LongType())])


#: Spark derives constraints through every alias of an expression, twice as many for each field that shares it.
CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def planned(method):
    """A method whose queries are planned without derived constraints, which would take exponential time for wide definitions."""

    @wraps(method)
    def run(self, *args, **options):
        with self._lock:
            if not self._depth:
                self._constraints = self.spark.conf.get(CONSTRAINTS)
                self.spark.conf.set(CONSTRAINTS, "false")
            self._depth += 1
        try:
            return method(self, *args, **options)
        finally:
            with self._lock:
                self._depth -= 1
                if not self._depth:
                    self.spark.conf.set(CONSTRAINTS, self._constraints)

    return run


@dataclass(frozen=True)
class Changed:
    """Changes of one table in a batch: every image pair (``raw``), and one net pair for each key (``net``, with the key's columns; rows to be read again have equal images)."""

    raw: DataFrame
    net: DataFrame
    told: bool = True  # every image is the table's row as it was; not if rows are to be read again


class Engine:
    """A database of sources and maintained targets under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 8, fuse: int = FUSE, threads: int = 4):
        self.spark, self.fuse, self.threads = spark, fuse, threads
        self._kept: list[DataFrame] = []
        self._writes: dict[str, Future] = {}
        self._lock, self._depth = threading.RLock(), 0
        self.store = Store(spark, root, buckets)
        if self.store.latest() is None:
            first = {"number": 0, "batch": -1, "seq": 0, "sources": {}, "transforms": {}, "tables": {}, "metrics": {}}
            self.store.put(first, self.store.empty(POISON, POISON_SCHEMA, ("transform", "key")))
            self.store.commit(first)

    # catalog

    @property
    def manifest(self) -> dict:
        return self.store.latest()

    def _commit(self, m: dict) -> None:
        m["number"] += 1
        self.store.commit(m)

    def source(self, name: str, rows: DataFrame, key: Iterable[str], *, unique: Iterable[Iterable[str]] = (), partitions: Iterable[str] = (), types: dict[str, str] | None = None, labels: dict[str, Iterable[str]] | None = None, verify: bool = True) -> None:
        """Register a source with its rows as of now. ``types`` names columns that Spark holds as text (uuid, enum, bpchar, ...), ``labels`` an enum's values.

        ``verify`` checks that ``key`` and each of ``unique`` hold every value once (NULLs, which the key may not have, aside).
        """
        m, key = self.manifest, tuple(key)
        if name in m["sources"] or name in m["transforms"]:
            raise refuse("TargetTableExists", name)
        declared = types or {}
        for k in key:
            kind = S.of_spark(rows.schema[k].dataType, declared.get(k))
            if kind.name not in S.KEYS:
                raise refuse("UnsupportedPrimaryKeyType", f"{k} {kind}")
        if verify:
            for k in (key, *map(tuple, unique)):
                full_key = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in k])
                if not rows.filter(full_key).groupBy(*[f"`{c}`" for c in k]).agg(F.count(F.lit(1)).alias("__times")).filter("__times > 1").isEmpty():
                    raise refuse("KeyNotBacked", f"{name} ({', '.join(k)}) holds a value twice")
            if not rows.filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in key])).isEmpty():
                raise refuse("NullInNotNullKey", f"{name} ({', '.join(key)})")
        m["sources"][name] = {"key": key, "unique": [list(u) for u in unique], "partitions": list(partitions), "types": declared, "labels": {k: list(v) for k, v in (labels or {}).items()}}
        size = max(self.store.buckets, -(-rows.count() // BUCKET_ROWS))
        self.store.put(m, self.store.write(self.store.empty(name, rows.schema, key, buckets=size), rows))
        self._commit(m)

    def _buckets(self, m: dict, d: Checked) -> int:
        """Buckets of a target: as many as the largest table that it reads has."""
        return max(self.store.entry(m, r.name).buckets for r in d.relations)

    def _relation(self, m: dict, name: str) -> Relation:
        bare = name.rpartition(".")[2]
        for x in (name, bare):
            if x in m["transforms"]:
                return self._checked(m, x).as_relation()
            if x in m["sources"]:
                s, fields = m["sources"][x], self.store.entry(m, x).struct
                columns = {f.name: S.of_spark(f.dataType, s["types"].get(f.name)) for f in fields}
                return Relation(x, columns, tuple(s["key"]), tuple(tuple(u) for u in s["unique"]), tuple(s["partitions"]), labels={k: tuple(v) for k, v in s["labels"].items()})
        if near := [x for x in (*m["sources"], *m["transforms"]) if x.lower() == bare.lower()]:
            raise refuse("NameCaseMismatch", f'{name}: did you mean "{near[0]}"?')
        raise refuse("SourceTableNotFound", name)

    def _checked(self, m: dict, target: str) -> Checked:
        found = m["transforms"][target]
        return check(parse(found["text"], found["grammar"]), lambda n: self._relation(m, n))

    def _name(self, m: dict, name: str) -> str:
        for x in (name, name.rpartition(".")[2]):
            if x in m["transforms"]:
                return x
        if near := [x for x in m["transforms"] if x.lower() == name.rpartition(".")[2].lower()]:
            raise refuse("NameCaseMismatch", f'{name}: did you mean "{near[0]}"?')
        raise refuse("TransformNotFound", name)

    def _readers(self, m: dict, name: str) -> list[str]:
        return [t for t, x in m["transforms"].items() if name in x["reads"]]

    # reading

    def _frame(self, m: dict, name: str) -> DataFrame:
        """A source's rows, or a target's, as the manifest has them."""
        bare = name if name in m["tables"] else name.rpartition(".")[2]
        if bare in self._writes:
            self._writes[bare].result()
        rows = self.store.read(self.store.entry(m, bare))
        if bare in m["sources"]:
            return rows
        d = self._checked(m, bare)
        return self._shown(d, rows)

    @staticmethod
    def _shown(d: Checked, rows: DataFrame) -> DataFrame:
        if d.kind in ("one_to_one", "join_one_to_one"):
            return rows
        return rows.select(*Partials(d.fields, key_types(d), d.scope).visible(rows, d.types))

    def table(self, name: str) -> DataFrame:
        """A target (or source) as of the last committed batch."""
        m = self.manifest
        if name not in m["sources"]:
            name = self._name(m, name)
            if name not in m["tables"]:
                raise refuse("TransformNotLive", f"{name} has not been built")
        return self._frame(m, name)

    # statements

    @planned
    def apply(self, text: str) -> dict:
        """Run one statement. Nothing reads source rows here; builds run in ``build`` and before the next batch."""
        s = parse(text)
        m = self.manifest
        if isinstance(s, Transform):
            out = self._define(m, s)
        elif isinstance(s, Alter):
            out = self._alter(m, s)
        else:
            out = self._lifecycle(m, s)
        self._commit(m)
        return out

    def _define(self, m: dict, t: Transform) -> dict:
        name = t.target.rpartition(".")[2]
        taken = name in m["sources"] or name in m["transforms"]
        if taken and not (t.adopt and m["sources"].get(name, {}).get("adoptable")):
            raise refuse("TargetTableExists", name)
        reads = []
        for x in t.tables:
            r = self._relation(m, x.name)
            if r.is_target and m["transforms"][r.name]["status"] not in (LIVE, WAITING):
                raise refuse("TransformNotLive", r.name)
            reads.append(r.name)
        t = replace(t, target=name)
        d = check(t, lambda n: self._relation(m, n))
        if t.adopt:
            self._adopt(m, d)
        m["transforms"][name] = {"text": str(replace(t, adopt=False)), "grammar": GRAMMAR, "reads": reads, "status": WAITING, "error": None, "deaths": {}, "paused_columns": [], "held": 0, "schemas": {r: self._fingerprint(m, r) for r in reads}}
        return {"defined": name, "columns": {n: str(k) for n, k in d.types.items()}, "key": list(d.key)}

    def create_table(self, name: str, schema: T.StructType) -> None:
        """An empty table of one's own, that a definition may adopt."""
        m = self.manifest
        if name in m["sources"] or name in m["transforms"]:
            raise refuse("TargetTableExists", name)
        m["sources"][name] = {"key": [], "unique": [], "partitions": [], "types": {}, "labels": {}, "adoptable": True}
        self.store.put(m, self.store.empty(name, schema, [f.name for f in schema][:1]))
        self._commit(m)

    def _adopt(self, m: dict, d: Checked) -> None:
        e = self.store.entry(m, d.target)
        if e is None:
            raise refuse("TargetNotAdoptable", f"{d.target} is missing")
        want = [(n, S.to_spark(t)) for n, t in d.types.items()]
        got = [(f.name, f.dataType.simpleString()) for f in e.struct]
        if [(n, T.StructType.fromDDL(f"`x` {t}")[0].dataType.simpleString()) for n, t in want] != got:
            raise refuse("TargetNotAdoptable", f"{d.target}: {got} is not {want}")
        if e.base and not self.store.read(e).isEmpty():
            raise refuse("TargetNotAdoptable", f"{d.target} has rows")
        del m["sources"][d.target], m["tables"][d.target]

    def _fingerprint(self, m: dict, name: str) -> str:
        e = self.store.entry(m, name)
        return e.struct.simpleString() if e and name in m["sources"] else ""

    def _alter(self, m: dict, s: Alter) -> dict:
        name = self._name(m, s.target)
        x, old = m["transforms"][name], self._checked(m, name)
        if old.kind != "one_to_one":
            raise refuse("UnsupportedAlter", f"{name} is no 1-1 transform of one table")
        if x["status"] != LIVE:
            raise refuse("TransformNotLive", name)
        fields = dict(old.text.fields)
        for verb, n, e in s.changes:
            if verb == "ADD":
                if n in fields:
                    raise refuse("AlterFieldAlreadyExists", n)
                fields[n] = e
            elif n not in fields:
                raise refuse("AlterFieldNotFound", n)
            elif verb == "ALTER":
                fields[n] = e
            else:
                del fields[n]
                if readers := [r for r in self._readers(m, name) if n in self._columns_read(m, r, name)]:
                    raise refuse("DependentsBlockDrop", f"{n} is read by {', '.join(readers)}")
        if not fields:
            raise refuse("UnsupportedAlter", "a transform keeps one field at least")
        t = replace(old.text, fields=tuple(fields.items()))
        d = check(t, lambda n: self._relation(m, n))
        for n, k in d.types.items():
            if n in old.types and S.to_spark(old.types[n]) != S.to_spark(k):
                raise refuse("UnsupportedAlter", f"{n} would change from {old.types[n]} to {k}")
        x["text"] = str(t)
        changed = [n for n, e in d.fields if dict(old.fields).get(n) != e]
        self._build_fields(m, d, changed)
        return {"altered": name, "built": changed}

    def _columns_read(self, m: dict, reader: str, table: str) -> set[str]:
        d = self._checked(m, reader)
        return {c for s, r in enumerate(d.relations) if r.name == table for c in delta.read_columns(d, s)}

    def _build_fields(self, m: dict, d: Checked, changed: list[str]) -> None:
        """Recompute some columns of a 1-1 target and keep the others."""
        e, schema = self.store.entry(m, d.target), self._target_schema(d)
        target = self.store.read(e)
        fresh = rows_of(d, self._frame(m, d.text.source.name), True, only=changed)
        new = target.alias("o").join(fresh.alias("f"), same_key("o", "f", d.key), "left")
        names = [f.name for f in schema]
        rows = new.select(*[F.col(f"f.`{n}`" if n in changed else f"o.`{n}`").alias(n) for n in names])
        shaped = replace(e, schema=json.dumps(schema.jsonValue()))
        entry = self.store.write(shaped, rows)
        self.store.put(m, entry)
        if self._readers(m, d.target):
            before = target.select(*[F.col(f"`{n}`") if n in target.columns else F.lit(None).alias(n) for n in names])
            self._propagate(m, {d.target: self._changes_of(m, d, feed(entry, before, self.store.read(entry)))})

    def _target_schema(self, d: Checked) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {S.to_spark(t)}" for n, t in d.types.items()))

    def _lifecycle(self, m: dict, s: Lifecycle) -> dict:
        if len(s.address) == 2 and s.verb != "DROP" and s.address[0] in m["transforms"] and s.address[1] in self._checked(m, s.address[0]).types:
            return self._column(m, s.verb, *s.address)
        if s.verb == "DROP":
            try:
                name = self._name(m, ".".join(s.address))
            except EngineError as e:
                if e.name == "TransformNotFound":
                    return {"dropped": False}
                raise
            if readers := self._readers(m, name):
                raise refuse("DependentsBlockDrop", f"{name} is read by {', '.join(readers)}")
            if m["transforms"][name]["status"] not in (PAUSED, QUARANTINED):
                raise refuse("TransformNotPaused", f"{name} is {m['transforms'][name]['status']}; PAUSE it first")
            self._unhold(m, name)
            for t in [k for k in m["tables"] if k == name or k.startswith(f"{name}.__")]:
                del m["tables"][t]
            del m["transforms"][name]
            return {"dropped": True}
        name = self._name(m, ".".join(s.address))
        x = m["transforms"][name]
        if s.verb == "PAUSE":
            x["status"], x["error"] = PAUSED, "paused by statement"
            return {"paused": name}
        if x["status"] not in (PAUSED, QUARANTINED):
            raise refuse("TransformNotPaused", name)
        self._checked(m, name)
        if stale := [r for r in x["reads"] if m["sources"].get(r, {}).get("drifted")]:
            raise refuse("TransformNotLive", f"the schema of {', '.join(stale)} has changed; replace the source first")
        x |= {"status": BACKFILLING, "error": None, "deaths": {}, "paused_columns": [], "schemas": {r: self._fingerprint(m, r) for r in x["reads"]}}
        self._rebuild(m, name)
        return {"resumed": name, "status": x["status"]}

    def _column(self, m: dict, verb: str, name: str, field: str) -> dict:
        x, d = m["transforms"][name], self._checked(m, name)
        if d.kind != "one_to_one" or field in d.key:
            raise refuse("UnsupportedAlter", f"{name}.{field} is no calculated field of a 1-1 transform")
        if verb == "PAUSE":
            x["paused_columns"] = sorted({*x["paused_columns"], field})
            return {"paused": f"{name}.{field}"}
        if field not in x["paused_columns"]:
            raise refuse("ColumnNotPaused", f"{name}.{field}")
        x["paused_columns"].remove(field)
        x["deaths"].pop(field, None)
        self._build_fields(m, d, [field])
        return {"resumed": f"{name}.{field}"}

    # builds

    @planned
    def build(self) -> list[str]:
        """Build every definition that waits; returns their names."""
        m = self.manifest
        waiting = [t for t, x in m["transforms"].items() if x["status"] == WAITING]
        for name in waiting:
            self._rebuild(m, name)
        if waiting:
            self._commit(m)
        return waiting

    @planned
    def request_backfill(self, table: str) -> list[str]:
        """Rebuild every live reader of a table in place."""
        m = self.manifest
        done = [r for r in self._readers(m, table) if m["transforms"][r]["status"] == LIVE]
        for name in done:
            self._rebuild(m, name)
        self._commit(m)
        return done

    def _rebuild(self, m: dict, name: str, readers: bool = True) -> None:
        """Recompute a target in full; its readers, if they are wanted, get the difference to what it held."""
        x = m["transforms"][name]
        d = self._checked(m, name)
        before = self.store.entry(m, name)
        frames = lambda n: self._frame(m, n)
        x["status"] = BACKFILLING
        self._unhold(m, name)
        began = time.time()
        try:
            if d.kind in ("one_to_one", "join_one_to_one"):
                rows = full(d, frames, guard=True)
                entry = self.store.empty(name, self._target_schema(d), d.key, buckets=self._buckets(m, d))
                if can_fail(d):
                    rows = self._stash(m, rows)
                    self._hold(m, d, rows.filter(F.col(ERROR).isNotNull()))
                    rows = rows.filter(F.col(ERROR).isNull())
                self.store.put(m, self.store.write(entry, rows.drop(ERROR)))
            else:
                p = Partials(d.fields, key_types(d), d.scope)
                if d.kind == "join":
                    self._build_sides(m, d)
                    j = JoinPlan(d)
                    left, right = (self.store.read(self.store.entry(m, f"{name}.__{s}")) for s in "pm")
                    state = j.total(j.matched(left, right, j.outer))
                else:
                    state = full_state(d, frames)
                entry = self.store.empty(name, p.schema, d.key, buckets=self._buckets(m, d))
                self.store.put(m, self.store.write(entry, state))
        except PySparkException as e:
            x |= {"status": QUARANTINED if d.kind == "join" else PAUSED, "error": str(e)[:500]}
            return
        x["status"] = QUARANTINED if x["held"] >= self.fuse else LIVE
        if x["status"] == QUARANTINED:
            x["error"] = f"{x['held']} keys failed while building"
        self._count(m, builds_total=1, build_seconds_total=time.time() - began)
        if readers and before is not None and self._readers(m, name):
            after = self.store.entry(m, name)
            shaped = replace(before, schema=json.dumps(self._target_schema(d).jsonValue()))
            self._propagate(m, {name: self._changes_of(m, d, feed(shaped, self._shown(d, self.store.read(before)), self._shown(d, self.store.read(after))))})

    def _build_sides(self, m: dict, d: Checked) -> None:
        j = JoinPlan(d)

        def build(s: int, label: str, t) -> None:
            schema = T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in j.side_columns(s).items()))
            e = replace(self.store.empty(f"{d.target}.__{label}", schema, j.side_key(s), j.k, self._buckets(m, d)), adds=True)
            self.store.put(m, self.store.write(e, j.side(s, self._frame(m, t.name))))

        with ThreadPoolExecutor(self.threads) as pool:
            list(pool.map(build, (0, 1), "pm", d.text.tables))

    # batches

    def _keep(self, rows: DataFrame) -> DataFrame:
        """``rows`` for several uses within the batch; what a lost executor held of them is computed again."""
        self._kept.append(rows.persist())
        return rows

    def _stash(self, m: dict, rows: DataFrame) -> DataFrame:
        """``rows`` written once for this batch, so that what reads them neither recomputes nor depends on lost executors."""
        path = f"{self.store.root}/tmp/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @planned
    def process(self, changes: dict[str, DataFrame], batch_id: int | None = None, seq: int | None = None) -> bool:
        """Apply one batch of changes (op, old, new and, if there, seq and change_id) by source. False if it was applied before."""
        self.build()
        m = self.manifest
        if batch_id is not None and batch_id <= m["batch"]:
            return False
        began = time.time()
        top = m["seq"] + 1 if seq is None else seq
        if unknown := [n for n in changes if n not in m["sources"]]:
            raise refuse("SourceTableNotFound", ", ".join(unknown))
        own = {n: rows for n, rows in changes.items() if not self._drifted(m, n, rows)}
        try:
            with ThreadPoolExecutor(self.threads) as pool:  # sources' snapshots are written while definitions advance
                raws = dict(zip(own, pool.map(lambda n: self._take_in(m, n, own[n], top, pool), own), strict=True))
                self._propagate(m, raws)
                for write in self._writes.values():
                    write.result()
        finally:
            self._writes = {}
            self._release()
        m["batch"] = m["batch"] + 1 if batch_id is None else batch_id
        m["seq"] = max(m["seq"], top)
        self._count(m, batches_total=1, batch_seconds_total=time.time() - began)
        self._observe(m, "batch_duration_seconds", time.time() - began)
        self._commit(m)
        self.store.files.delete("tmp")
        return True

    def _count(self, m: dict, **more: float) -> None:
        with self._lock:
            for k, v in more.items():
                m["metrics"][k] = round(m["metrics"].get(k, 0) + v, 6)

    def _observe(self, m: dict, name: str, seconds: float) -> None:
        """Count a duration in its histogram: by the first bound that is no less, the sum of seconds last."""
        with self._lock:
            h = m.setdefault("histograms", {}).setdefault(name, [0] * (len(LATENCIES) + 1) + [0.0])
            h[next((i for i, x in enumerate(LATENCIES) if seconds <= x), len(LATENCIES))] += 1
            h[-1] = round(h[-1] + seconds, 6)

    def _drifted(self, m: dict, name: str, rows: DataFrame) -> bool:
        """Whether changes no longer have what a source's rows had. Its readers are paused then, until ``replace_source``; added columns do no harm."""
        want, got = self.store.entry(m, name).struct, {f.name: f.dataType for f in rows.schema["new"].dataType}
        lost = [f.name for f in want if got.get(f.name) != f.dataType]
        if lost:
            m["sources"][name]["drifted"] = True
        if not m["sources"][name].get("drifted"):
            return False
        for r in self._readers(m, name):
            m["transforms"][r] |= {"status": PAUSED, "error": f"schema of {name} changed: {', '.join(lost) or 'it'} is missing or of another type"}
        return True

    @planned
    def replace_source(self, name: str, rows: DataFrame, *, types: dict[str, str] | None = None) -> dict[str, str]:
        """Take a source's rows as they are now, whose columns may have been added, dropped, renamed or given other types.

        All that reads it, directly or by way of other targets, is checked again and rebuilt, or paused with the reason
        where it no longer holds. Returns the status of each.
        """
        m = self.manifest
        if name not in m["sources"]:
            raise refuse("SourceTableNotFound", name)
        s, e = m["sources"][name], self.store.entry(m, name)
        if gone := [k for k in s["key"] if k not in rows.columns]:
            raise refuse("SourceKeyChanged", f"{name}: {', '.join(gone)}")
        s |= {"drifted": False, "types": {**s["types"], **(types or {})}, "unique": [u for u in s["unique"] if set(u) <= set(rows.columns)]}
        self.store.put(m, self.store.write(replace(e, schema=json.dumps(nullable(rows.schema).jsonValue())), rows))
        out, reached, waiting = {}, {name}, list(m["transforms"])
        while waiting:  # each after all that it reads
            found = next(t for t in waiting if not set(m["transforms"][t]["reads"]) & set(waiting))
            waiting.remove(found)
            if not set(m["transforms"][found]["reads"]) & reached:
                continue
            x = m["transforms"][found]
            reached.add(found)
            if x["status"] == WAITING:
                continue
            was_paused = x["status"] == PAUSED and x["error"] == "paused by statement"
            try:
                self._checked(m, found)
                if not was_paused:
                    x |= {"status": BACKFILLING, "error": None}
                    self._rebuild(m, found, readers=False)
            except EngineError as error:
                x |= {"status": PAUSED, "error": str(error)}
            x["schemas"] = {r: self._fingerprint(m, r) for r in x["reads"]}
            out[found] = x["status"]
        self._count(m, drift_rebuilds_total=sum(s == LIVE for s in out.values()))
        self._commit(m)
        return out

    def _take_in(self, m: dict, name: str, rows: DataFrame, seq: int, pool: ThreadPoolExecutor) -> Changed:
        """Have a source's snapshot brought up to date in ``pool``; returns its changes."""
        e = self.store.entry(m, name)
        key = tuple(m["sources"][name]["key"])
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(seq).cast("bigint"))
        if "change_id" not in rows.columns:
            rows = rows.withColumn("change_id", F.monotonically_increasing_id())
        no_key = reduce(lambda a, b: a | b, [(F.col(side).isNotNull() & F.col(f"{side}.`{k}`").isNull()) for side in ("old", "new") for k in key])
        seen = Observation()  # counted while the changes are written
        image = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.`{f.name}`") for f in e.struct])).cast(e.struct).alias(c)
        rows = rows.select("op", "seq", "change_id", image("old"), image("new"))
        counts = [F.count(F.when(F.col("op") == op, 1)).alias(op) for op in delta.OPS]
        rows = self._stash(m, rows.observe(seen, F.count(F.lit(1)).alias("all"), *counts, F.count(F.when(no_key, 1)).alias("no_key"), F.max(F.when(F.col("op") == "truncate", F.col("seq"))).alias("floor")))
        got = seen.get
        ops = {op: got[op] for op in delta.OPS if got[op]}
        if sum(ops.values()) < got["all"]:
            raise ValueError(f"unknown op among {got['all']} changes of {name}")
        if got["no_key"]:
            for r in self._readers(m, name):
                m["transforms"][r] |= {"status": PAUSED, "error": str(refuse("NullInNotNullKey", name))}
            rows = rows.filter(~F.coalesce(no_key, F.lit(False)))
        imaged = delta.images(rows, key, got["floor"])
        snapshot = self.store.read(e)
        if "truncate" in ops:
            gone = snapshot.select(F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("change_id"), F.struct(*[f"`{f.name}`" for f in e.struct]).cast(e.struct).alias("old"), F.lit(None).cast(e.struct).alias("new"))
            imaged = imaged.unionByName(gone)
        if "recompute" in ops:  # without images: the row as it is, read again
            named = rows.filter("op = 'recompute'").select(*delta.key_of(key)).distinct()
            held = snapshot.alias("a").join(named.alias("b"), same_key("a", "b", key), "left_semi").select(F.struct(*[f"`{f.name}`" for f in e.struct]).cast(e.struct).alias("r"))
            imaged = imaged.unionByName(held.select(F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("change_id"), F.col("r").alias("old"), F.col("r").alias("new")))
        net = imaged.select(*delta.key_of(key), "old", "new")
        keys = [f"`{k}`" for k in key]
        many = self._keep(net.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times")).filter("__times > 1").select(*keys))
        if not many.isEmpty():  # only keys that change several times are folded
            several = imaged.select("*", *delta.key_of(key)).alias("a").join(many.alias("b"), same_key("a", "b", key), "left_semi")
            once = net.alias("a").join(many.alias("b"), same_key("a", "b", key), "left_anti")
            net = self._keep(once.unionByName(delta.fold(several.select("seq", "change_id", "old", "new"), key)))
        moved = net.filter(~F.col("old").eqNullSafe(F.col("new")))
        known = 0 if "truncate" in ops or "recompute" in ops else got["all"]
        rows = moved.select(F.coalesce("new", "old").alias("r"), F.col("new").isNull().alias(GONE)).select("r.*", GONE)
        self._writes[name] = pool.submit(lambda: self.store.put(m, self.store.change(e, rows, known)))
        self._count(m, changes_total=sum(ops.values()))
        return Changed(imaged, net, "recompute" not in ops)

    def _changes_of(self, m: dict, d: Checked, rows: DataFrame) -> Changed:
        """A target's (old, new) rows, one for each key, for its readers."""
        rows = self._stash(m, rows)
        return Changed(rows, rows.select(*delta.key_of(d.key), "old", "new"))

    def _propagate(self, m: dict, raws: dict[str, Changed]) -> None:
        """Bring every live definition up to date with changes of the tables in ``raws``: those whose tables are up to date at once, then their readers."""
        waiting = [n for n, x in m["transforms"].items() if x["status"] == LIVE]
        while waiting:
            ready = [n for n in waiting if not any(r in waiting for r in m["transforms"][n]["reads"])]
            waiting = [n for n in waiting if n not in ready]
            stale = [n for n in ready if any(r in raws for r in m["transforms"][n]["reads"])]
            with ThreadPoolExecutor(self.threads) as pool:
                for name, out in zip(stale, pool.map(lambda n: self._advance(m, n, raws), stale), strict=True):
                    if out is not None:
                        raws[name] = out
    def _release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def _advance(self, m: dict, name: str, raws: dict[str, Changed]) -> Changed | None:
        """Bring one definition up to date; returns its own changes if anything reads it."""
        d, began = self._checked(m, name), time.time()
        try:
            out = {"one_to_one": self._one_to_one, "join_one_to_one": self._join_one_to_one, "aggregate": self._aggregate, "join": self._join}[d.kind](m, d, raws)
            self._observe(m, f"transform_seconds:{name}", time.time() - began)
            if out is None or not self._readers(m, name):
                return None
            return self._changes_of(m, d, out)
        except PySparkException as e:
            m["transforms"][name] |= {"status": QUARANTINED, "error": str(e)[:500]}
            return None

    def _net(self, m: dict, changed: Changed, relation: Relation) -> DataFrame:
        """Net changes of a table by the key that the definition keys it by."""
        key = relation.key
        if relation.is_target or set(m["sources"][relation.name]["key"]) == set(key):
            return changed.net
        net = changed.net.select(F.lit(0).alias("seq"), F.lit(0).alias("change_id"), "old", "new")  # another unique key: in the end one row at most holds each of its values
        net = delta.split_moved(net, key).select(*delta.key_of(key), "old", "new").groupBy(*[f"`{k}`" for k in key])
        return net.agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))

    def _one_to_one(self, m: dict, d: Checked, raws: dict[str, Changed]) -> DataFrame | None:
        x = m["transforms"][d.target]
        net = self._net(m, raws[d.relations[0].name], d.relations[0])
        healthy = [n for n, _ in d.fields if n not in x["paused_columns"]]
        if len(healthy) == len(d.fields) and not x["held"] and not can_fail(d) and raws[d.relations[0].name].told:
            return self._put_images(m, d, net)
        keys = net.select(*[f"`{k}`" for k in d.key])
        rows = rows_of(d, net.filter("new IS NOT NULL").select("new.*"), True, only=healthy)
        return self._put_rows(m, d, keys, rows, healthy)

    def _join_one_to_one(self, m: dict, d: Checked, raws: dict[str, Changed]) -> DataFrame | None:
        nets = {t.name: self._net(m, raws[r.name], r) for t, r in zip(d.text.tables, d.relations, strict=True) if r.name in raws}
        keys, rows = delta.join_one_to_one(d, nets, lambda n: self._frame(m, n), True)
        return self._put_rows(m, d, keys, rows, [n for n, _ in d.fields])

    def _put_images(self, m: dict, d: Checked, net: DataFrame) -> DataFrame | None:
        """Write a 1-1 target's rows where none can fail, from both images of its table's rows and without a look at the target."""
        e = self.store.entry(m, d.target)
        images = net.select(*[row_image(d, x).alias(x) for x in ("old", "new")]).filter(~F.col("old").eqNullSafe(F.col("new")))
        if self._readers(m, d.target):
            images = self._keep(images)
        rows = images.select(F.coalesce("new", "old").alias("r"), F.col("new").isNull().alias(GONE)).select("r.*", GONE)
        self.store.put(m, self.store.change(e, rows, self.store.counted(e, images)))
        return images if self._readers(m, d.target) else None

    def _put_rows(self, m: dict, d: Checked, keys: DataFrame, rows: DataFrame, healthy: list[str]) -> DataFrame | None:
        """Write a 1-1 target's rows for some keys; keys whose row fails are held and keep what they have. Returns the target's changes if anything reads it."""
        x, e = m["transforms"][d.target], self.store.entry(m, d.target)
        keys = self._keep(keys)
        if len(healthy) < len(d.fields):  # paused columns keep their values
            old = self.store.read(e, self.store.touched(e, keys))
            both = rows.alias("f").join(old.alias("o"), same_key("f", "o", d.key), "left")
            rows = both.select(*[F.col(f"o.`{n}`" if n in x["paused_columns"] else f"f.`{n}`").alias(n) for n in d.types], F.col(f"f.{ERROR}").alias(ERROR))
        if x["held"]:
            self._unhold(m, d.target, keys)
        fails = can_fail(d, healthy)
        read = self._readers(m, d.target)
        rows = self._keep(rows) if fails or read else rows
        entry, n_failed = self.store.upsert(e, keys, rows, ERROR if fails else None, self.store.counted(e, keys))
        self.store.put(m, entry)
        good = rows.filter(F.col(ERROR).isNull())
        if n_failed:
            failed = rows.filter(F.col(ERROR).isNotNull())
            for f, n in failed.groupBy(F.col(f"{ERROR}.field")).count().collect():
                x["deaths"][f] = x["deaths"].get(f, 0) + n
            self._hold(m, d, failed)
            keys = keys.alias("k").join(failed.select(*[f"`{k}`" for k in d.key]).alias("f"), same_key("k", "f", d.key), "left_anti")
            tripped = [f for f, n in x["deaths"].items() if n >= self.fuse and f not in x["paused_columns"]]
            if tripped and d.kind == "one_to_one":
                x["paused_columns"] = sorted({*x["paused_columns"], *tripped})
            elif x["held"] >= self.fuse:
                x |= {"status": QUARANTINED, "error": f"{x['held']} keys failed"}
        return self.store.changed(e, keys, good.drop(ERROR)) if read else None

    def _aggregate(self, m: dict, d: Checked, raws: dict[str, Changed]) -> DataFrame | None:
        p = Partials(d.fields, key_types(d), d.scope)
        source = d.relations[0].name
        parts, failed = delta.aggregate(d, p, raws[source].raw)
        if failed is not None:
            self._hold_sides(m, d, failed)
        return self._put_groups(m, d, p, parts, source)

    def _put_groups(self, m: dict, d: Checked, p: Partials, parts: DataFrame, source: str | None) -> DataFrame:
        """Add partials to a target's state; groups that lose an extreme are read again from the source."""
        e = self.store.entry(m, d.target)
        parts = self._keep(parts)
        touched = self.store.touched(e, parts)
        merged = self._keep(p.merged(parts, self.store.read(e, touched)))
        names = [f"`{k}`" for k in p.keys]
        rows, n, probed = merged.select("new.*", (F.col(f"new.{N}") <= 0).alias(GONE)), self.store.counted(e, merged), False
        if p.extremes:
            probe = merged.filter("probe").filter(F.col(f"new.{N}") > 0).select(*names)
            if probed := not probe.isEmpty():
                again = delta.probed(d, p, probe, self._frame(m, source))
                kept = merged.filter((~F.col("probe")) | (F.col(f"new.{N}") <= 0)).select("new.*", (F.col(f"new.{N}") <= 0).alias(GONE))
                rows, n = kept.unionByName(again.select(*[f"`{f.name}`" for f in p.schema], F.lit(False).alias(GONE))), 0
        entry = self.store.change(e, rows, n)
        self.store.put(m, entry)
        if not self._readers(m, d.target):
            return None
        if not probed:  # the merged rows have both images
            both = merged.select("old", F.when(F.col(f"new.{N}") > 0, F.col("new")).alias("new"))
            images = both.select(*[F.when(F.col(x).isNotNull(), F.struct(*p.visible(both, d.types, x))).alias(x) for x in ("old", "new")])
            return images.filter(~F.col("old").eqNullSafe(F.col("new")))
        shaped = replace(e, schema=json.dumps(self._target_schema(d).jsonValue()))
        old = merged.filter("old IS NOT NULL").select("old.*")
        new = self.store.read(entry, touched).alias("a").join(merged.select(*names).alias("b"), same_key("a", "b", p.keys), "left_semi")
        return feed(shaped, self._shown(d, old), self._shown(d, new))

    def _join(self, m: dict, d: Checked, raws: dict[str, Changed]) -> DataFrame | None:
        j = JoinPlan(d)
        deltas: list[DataFrame | None] = [None, None]
        entries = [self._adding(self.store.entry(m, f"{d.target}.__{s}")) for s in "pm"]
        touched: list[list[int] | None] = [[], []]
        for s, r in enumerate(d.relations):
            if r.name in raws:
                signed = delta.sides(raws[r.name].raw, delta.read_columns(d, s))
                part = j.side(s, signed, F.col("__w"), "r").select(*[f"`{c}`" for c in j.side_columns(s)])
                deltas[s] = self._keep(part.filter(j.something(s)))
                touched[s] = self.store.touched(entries[s], deltas[s])
        dp, dm = deltas
        either = None if None in touched else sorted({*touched[0], *touched[1]})
        p_old, m_old = self.store.read(entries[0], touched[1]), self.store.read(entries[1], either)
        for s in (0, 1):
            if deltas[s] is not None:
                self.store.put(m, self.store.add(entries[s], deltas[s], lambda rows, s=s: j.cells(s, rows)))
        m_new = m_old if dm is None else m_old.unionByName(dm)
        parts = delta.join_delta(j, dp, dm, p_old, m_old, m_new)
        return self._put_groups(m, d, j.p, parts, None)

    def _adding(self, e: Entry) -> Entry:
        """P or M as a table of rows that add up; folders of changes that replaced cells, as they once were, are merged first."""
        return e if e.adds else replace(self.store.write(e, self.store.read(e)) if e.deltas else e, adds=True)

    # quarantine

    def _hold(self, m: dict, d: Checked, failed: DataFrame) -> None:
        """Note failed target rows (key and ``__error``)."""
        rows = failed.select(F.lit(d.target).alias("transform"), F.lit(d.relations[0].name).alias("src_table"), F.to_json(F.struct(*[f"`{k}`" for k in d.key])).alias("key"), F.col(f"{ERROR}.field").alias("field"), F.col(f"{ERROR}.state").alias("state"), F.lit(m["seq"]).cast("bigint").alias("seq"))
        self._poison(m, d.target, rows)

    def _hold_sides(self, m: dict, d: Checked, failed: DataFrame) -> None:
        """Note source rows that an aggregate's arguments fail on; a row that is gone again is not held."""
        key = d.relations[0].key
        rows = failed.select(F.lit(d.target).alias("transform"), F.lit(d.relations[0].name).alias("src_table"), F.to_json(F.struct(*[F.col(f"r.`{k}`") for k in key])).alias("key"), F.lit(None).cast("string").alias("field"), "state", F.lit(m["seq"]).cast("bigint").alias("seq"), "__w")
        rows = self._stash(m, rows.groupBy("transform", "src_table", "key", "field", "seq").agg(F.max("state").alias("state"), F.sum("__w").alias("w")))
        if rows.isEmpty():
            return
        self._unhold(m, d.target, None, rows.select("transform", "key"))
        self._poison(m, d.target, rows.filter("w > 0"))
        if m["transforms"][d.target]["held"] >= self.fuse:
            m["transforms"][d.target] |= {"status": QUARANTINED, "error": f"{m['transforms'][d.target]['held']} keys failed"}

    def _poison(self, m: dict, name: str, rows: DataFrame) -> None:
        with self._lock:
            e = self.store.entry(m, POISON)
            rows = self._stash(m, rows.select(*[f.name for f in e.struct]))
            self.store.put(m, self.store.upsert(e, rows.select("transform", "key"), rows)[0])
            self._recount(m, name)

    def _recount(self, m: dict, name: str) -> None:
        m["transforms"][name]["held"] = self.store.read(self.store.entry(m, POISON)).filter(F.col("transform") == name).count()

    def _unhold(self, m: dict, name: str, keys: DataFrame | None = None, marked: DataFrame | None = None) -> None:
        """Forget held keys of a transform: all, or some."""
        if not m["transforms"][name]["held"]:
            return
        with self._lock:
            e = self.store.entry(m, POISON)
            if keys is not None:
                marked = keys.select(F.lit(name).alias("transform"), F.to_json(F.struct(*[f"`{k}`" for k in keys.columns])).alias("key"))
            if marked is None:
                marked = self.store.read(e).filter(F.col("transform") == name).select("transform", "key")
            marked = self._stash(m, marked)
            self.store.put(m, self.store.upsert(e, marked, self.spark.createDataFrame([], POISON_SCHEMA))[0])
            self._recount(m, name)

    def quarantined(self, name: str | None = None) -> DataFrame:
        """Held keys: transform, src_table, key (JSON), field, state, seq."""
        rows = self.store.read(self.store.entry(self.manifest, POISON))
        return rows if name is None else rows.filter(F.col("transform") == self._name(self.manifest, name))

    def quarantine_status(self, name: str) -> dict:
        m = self.manifest
        x = m["transforms"][self._name(m, name)]
        return {"held_keys": x["held"], "deaths": x["deaths"], "paused_columns": x["paused_columns"]}

    def sample_quarantined(self, name: str, n: int = 10) -> list[dict]:
        return [r.asDict() for r in self.quarantined(name).orderBy("key").limit(n).collect()]

    def poisoned_since(self, seq: int) -> DataFrame:
        return self.quarantined().filter(F.col("seq") >= seq)

    @planned
    def release_key(self, name: str, **key) -> bool:
        """Try a held key again; True if it applies now."""
        m = self.manifest
        name = self._name(m, name)
        d = self._checked(m, name)
        source = d.relations[0]
        if set(key) != set(source.key):
            raise refuse("KeyNotHeld", f"{name} {key}: the key is {', '.join(source.key)}")
        row = self.spark.createDataFrame([key]).select(*[F.col(k).cast(S.to_spark(source.columns[k])).alias(k) for k in source.key])
        text = row.select(F.to_json(F.struct(*[f"`{k}`" for k in source.key]))).first()[0]
        if self.quarantined(name).filter(F.col("key") == text).isEmpty():
            raise refuse("KeyNotHeld", f"{name} {text}")
        if d.kind in ("one_to_one", "join_one_to_one"):
            now = self._frame(m, d.text.source.name).alias("a").join(row.alias("b"), same_key("a", "b", source.key), "left_semi")
            from deltaloom.operators.full import joined

            out = self._put_rows(m, d, row, rows_of(d, joined(d, lambda n: self._frame(m, n), now), True), [n for n, _ in d.fields])
            if self._readers(m, name):
                self._propagate(m, {name: self._changes_of(m, d, out)})
        done = self.store.read(self.store.entry(m, POISON)).filter((F.col("transform") == name) & (F.col("key") == text)).isEmpty()
        self._count(m, held_key_retries_total=1, held_key_retries_succeeded_total=int(done))
        self._commit(m)
        return done

    @planned
    def correct_partition(self, name: str, values: dict[str, object], rows: DataFrame | None = None) -> bool:
        """A partition of a source attached or replaced (``rows``), or dropped or emptied (None): its rows and what is grouped from them are corrected."""
        m = self.manifest
        if set(values) != set(m["sources"][name]["partitions"]):
            raise refuse("PartitionedSource", f"{name} is partitioned by {m['sources'][name]['partitions']}")
        here = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in values.items()])
        e = self.store.entry(m, name)
        was = self.store.read(e).filter(here)
        now = self.spark.createDataFrame([], e.struct) if rows is None else rows.filter(here)
        shifted = feed(e, was, now).select(F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update").alias("op"), "old", "new")
        return self.process({name: shifted})

    # reports

    def schema_dump(self) -> str:
        """Targets as CREATE TABLE statements."""
        m = self.manifest
        out = []
        for n in m["transforms"]:
            d = self._checked(m, n)
            columns = ", ".join(f'"{c}" {t}' for c, t in d.types.items())
            out.append(f'CREATE TABLE "{n}" ({columns}, UNIQUE ({", ".join(chr(34) + k + chr(34) for k in d.key)}));\n')
        return "".join(out)

    def filter_schema_dump(self, text: str) -> str:
        """A dump of CREATE TABLE statements without the targets that definitions make again, and without their hidden parts."""
        m, kept = self.manifest, []
        for s in split_statements(text):
            made = re.match(r'CREATE\s+TABLE\s+(?:"((?:[^"]|"")*)"|([\w.]+))', s, re.I)
            name = (made[1] or made[2]).rpartition(".")[2] if made else None
            if name not in m["transforms"] and not (name or "").startswith("__") and ".__" not in (made[0] if made else ""):
                kept.append(s + ";\n")
        return "".join(kept)

    def definitions(self) -> dict[str, dict]:
        return {n: {k: x[k] for k in ("text", "grammar", "reads", "status")} for n, x in self.manifest["transforms"].items()}

    def dump_definitions_sql(self) -> str:
        """All definitions as statements, in an order in which they can be applied."""
        return "".join(x["text"] + ";\n" for x in self.manifest["transforms"].values())

    def restore_definitions_sql(self, text: str) -> list[str]:
        """Apply dumped statements; literals may hold anything."""
        return [self.apply(s)["defined"] for s in split_statements(text)]

    def target_select_sql(self, name: str) -> str:
        m = self.manifest
        return target_select_sql(self._checked(m, self._name(m, name)))

    def status(self, name: str) -> dict:
        m = self.manifest
        x = m["transforms"][self._name(m, name)]
        pending = x["status"] == LIVE and self._pending(m) > 0
        return {"status": CATCHING_UP if pending else x["status"], "error": x["error"], "held_keys": x["held"], "paused_columns": x["paused_columns"], "seq": m["seq"]}

    def _pending(self, m: dict) -> int:
        return max(0, self.watermark_token() - m["seq"])

    def watermark_token(self) -> int:
        """The position after all changes appended so far."""
        names = [n for n in self.store.files.list("log/commits") if n.endswith(".json")]
        return max(int(names[-1].removesuffix(".json")) if names else 0, self.manifest["seq"])

    def await_converged(self, token: int, timeout: float = 60.0, poll: float = 0.2) -> int:
        """Wait until every change up to ``token`` has been applied by whoever drains the log."""
        end = time.time() + timeout
        while (seq := self.manifest["seq"]) < token:
            if time.time() > end:
                raise refuse("ConvergenceTimeout", f"at {seq}, not at {token}")
            time.sleep(poll)
        return seq

    @planned
    def self_check(self, name: str) -> dict:
        """Compare a target with a full recompute, as multisets both ways. Held keys and paused columns are left out."""
        m = self.manifest
        name = self._name(m, name)
        x, d = m["transforms"][name], self._checked(m, name)
        columns = [f"`{n}`" for n in d.types if n not in x["paused_columns"]]
        want = full(d, lambda n: self._frame(m, n), guard=True)
        if ERROR in want.columns:
            want = want.filter(F.col(ERROR).isNull() if not x["paused_columns"] else F.col(f"{ERROR}.field").isNull() | F.col(f"{ERROR}.field").isin(x["paused_columns"]))
        got = self._frame(m, name)
        if x["held"] and d.kind != "aggregate":
            held = self.quarantined(name).select("key")
            got = got.withColumn("__key", F.to_json(F.struct(*[f"`{k}`" for k in d.key]))).join(held, F.col("__key") == held["key"], "left_anti")
        sided = want.select(*columns, F.lit(1).alias(SIGN)).unionByName(got.select(*columns, F.lit(-1).alias(SIGN)))
        odd = sided.groupBy(*columns).agg(F.sum(SIGN).alias(SIGN)).filter(F.col(SIGN) != 0)
        missing, extra = odd.agg(*[F.coalesce(F.sum(F.greatest(s, F.lit(0))), F.lit(0)) for s in (F.col(SIGN), -F.col(SIGN))]).first()
        return {"target": name, "ok": not missing and not extra, "missing": missing, "extra": extra, "held_keys": x["held"]}

    def metrics(self) -> str:
        """Counters, gauges and histograms in the Prometheus text format."""
        m = self.manifest
        of = m["transforms"]
        pending = self._pending_commits(m)
        gauges = {"up": 1, "seq": m["seq"], "batch": m["batch"], "pending_commits": len(pending), "pending_bytes": sum(n for n, _ in pending), "oldest_pending_age_seconds": round(time.time() - min(t for _, t in pending), 3) if pending else 0}
        gauges |= {"definitions": len(of), "paused_definitions": sum(x["status"] == PAUSED for x in of.values()), "quarantined_definitions": sum(x["status"] == QUARANTINED for x in of.values())}
        gauges |= {"definitions_with_paused_columns": sum(bool(x["paused_columns"]) for x in of.values()), "paused_columns": sum(len(x["paused_columns"]) for x in of.values()), "drifted_sources": sum(bool(s.get("drifted")) for s in m["sources"].values())}
        entries = {t: self.store.entry(m, t) for t in m["tables"]}
        gauges |= {"base_bytes": sum(e.size for e in entries.values()), "change_bytes": sum(n for e in entries.values() for _, n in e.deltas), "change_folders": sum(len(e.deltas) for e in entries.values())}
        lines = [f"deltaloom_{k} {v}" for k, v in sorted((m["metrics"] | gauges).items())]
        for n, x in of.items():
            label = f'transform="{quote_table(n)}"'
            lines += [f"deltaloom_held_keys{{{label}}} {x['held']}", f"deltaloom_column_failures_total{{{label}}} {sum(x['deaths'].values())}", f'deltaloom_status{{{label},status="{x["status"]}"}} 1']
        for name, h in sorted(m.get("histograms", {}).items()):
            kind, _, target = name.partition(":")
            label = f'transform="{quote_table(target)}",' if target else ""
            for i, bound in enumerate([*LATENCIES, "+Inf"]):
                lines.append(f'deltaloom_{kind}_bucket{{{label}le="{bound}"}} {sum(h[: i + 1])}')
            own = f"{{{label.rstrip(',')}}}" if label else ""
            lines += [f"deltaloom_{kind}_sum{own} {h[-1]}", f"deltaloom_{kind}_count{own} {sum(h[:-1])}"]
        return "\n".join(lines) + "\n"

    def _pending_commits(self, m: dict) -> list[tuple[int, float]]:
        """Bytes and time of each commit that has not been applied."""
        files, out = self.store.files, []
        for n in files.list("log/commits"):
            if n.endswith(".json") and int(n.removesuffix(".json")) > m["seq"]:
                marker = json.loads(files.read(f"log/commits/{n}"))
                status = files.fs.getFileStatus(files.path(f"log/commits/{n}"))
                out.append((sum(files.size(f"log/{t}") for t in marker["tables"]), status.getModificationTime() / 1000))
        return out

    def start_self_check(self, name: str) -> str:
        """Audit a target in the background; returns the job's id for ``self_check_job``."""
        job = uuid.uuid4().hex
        target = self._name(self.manifest, name)
        self.store.files.write(f"checks/{job}.started.json", json.dumps({"id": job, "target": target, "status": "running"}))

        def run() -> None:
            try:
                out = {"status": "done", "result": self.self_check(target)}
            except (EngineError, PySparkException) as error:
                out = {"status": "failed", "error": str(error)[:500]}
            self.store.files.write(f"checks/{job}.ended.json", json.dumps({"id": job, "target": target} | out))

        threading.Thread(target=run, daemon=True).start()
        return job

    def self_check_job(self, job: str) -> dict | None:
        """What an audit has come to; None of an unknown one."""
        for state in ("ended", "started"):
            if self.store.files.exists(f"checks/{job}.{state}.json"):
                return json.loads(self.store.files.read(f"checks/{job}.{state}.json"))
        return None

    def detect_capture_disruptions(self) -> list[str]:
        """Tables of which a file folder is gone; their readers have to be paused and resumed once the source is registered again."""
        m = self.manifest
        return sorted(n for n in m["tables"] if not all(map(self.store.files.exists, self.store.entry(m, n).folders)))

    @planned
    def rebucket(self, name: str, buckets: int) -> None:
        """Give a table that has grown (a source, or a target with its hidden parts) another number of buckets."""
        m = self.manifest
        for part in [t for t in m["tables"] if t == name or t.startswith(f"{name}.__")]:
            e = self.store.entry(m, part)
            self.store.put(m, self.store.write(replace(e, buckets=buckets), self.store.read(e)))
        self._commit(m)

    def vacuum(self) -> int:
        """Delete files that the latest manifest does not name, and older manifests; returns the number of folders."""
        m = self.manifest
        live = {v for n in m["tables"] for v in self.store.entry(m, n).folders}
        gone = 0
        for name in self.store.files.list("data"):
            for version in self._versions(f"data/{name}"):
                if version not in live:
                    self.store.files.delete(version)
                    gone += 1
        for n in [n for n in self.store.files.list("manifest") if n.endswith(".json")][:-1]:
            self.store.files.delete(f"manifest/{n}")
        self.store.files.delete("tmp")
        return gone

    def _versions(self, folder: str) -> list[str]:
        out = []
        for n in self.store.files.list(folder):
            out += [f"{folder}/{n}"] if len(n) == 32 and "_" not in n else self._versions(f"{folder}/{n}")
        return out


__all__ = ["Col", "Engine"]
