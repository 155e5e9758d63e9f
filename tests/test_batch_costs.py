"""What a batch writes and computes: nothing twice, and nothing that its result does not need."""

import pytest
from pyspark.sql import functions as F

from deltaloom.sources import store
from deltaloom.sources.changelog import deletes, inserts, updates
from deltaloom.streaming.engine import Engine


def numbers(spark, n: int):
    return spark.range(n).select(F.col("id"), (F.col("id") % 10).alias("g"), (F.col("id") * 3).alias("v"))


def exact(e: Engine, *names: str) -> bool:
    return all(e.self_check(n)["ok"] for n in names)


@pytest.mark.parametrize("few", [0, 16])
def test_a_batch_of_most_rows_goes_into_the_new_base_at_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(store, "LEAST_BYTES", 1)
    monkeypatch.setattr(store, "FEW_BUCKETS", few)
    e = Engine(spark, str(tmp_path), buckets=3)
    rows = numbers(spark, 2000)
    e.source("s", rows, ["id"])
    e.apply("TRANSFORM t FROM s SELECT v + 1 AS w, g AS g")
    e.apply("TRANSFORM r FROM t GROUP BY g SELECT SUM(w) AS w, COUNT(*) AS n")
    e.apply("TRANSFORM q FROM s GROUP BY id, g SELECT SUM(v) AS v")
    e.build()
    e.process({"s": updates(rows.filter("id % 2 = 0"), v=F.col("v") + 1).unionByName(deletes(rows.filter("id % 4 = 1"))).unionByName(inserts(rows.filter("id % 4 = 3").withColumn("id", F.col("id") + 10_000)))})
    for name in ("s", "t", "q"):
        entry = e.store.entry(e.manifest, name)
        assert not entry.deltas and entry.rows == entry_rows(e, name) == 2000
        assert len(e.store.files.list(f"data/{name}")) == 2  # the base as built, and the new one
    assert exact(e, "t", "r", "q")


def entry_rows(e: Engine, name: str) -> int:
    return e.store.read(e.store.entry(e.manifest, name)).count()


def test_keys_that_fail_keep_their_rows_in_a_new_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEAST_BYTES", 1)
    e = Engine(spark, str(tmp_path), buckets=3, fuse=1000)
    rows = numbers(spark, 200).withColumn("v", F.lit(1).cast("bigint"))
    e.source("s", rows, ["id"])
    e.apply("TRANSFORM t FROM s SELECT 6.0 / v AS w")
    e.build()
    e.process({"s": updates(rows.filter("id < 100"), v=F.when(F.col("id") < 20, 0).otherwise(2))})
    assert not e.store.entry(e.manifest, "t").deltas
    assert e.status("t")["held_keys"] == 20
    got = {r["id"]: float(r["w"]) for r in e.table("t").collect()}
    assert got == {i: 6.0 if i < 20 or i >= 100 else 3.0 for i in range(200)}


def refused(*args, **options):
    raise AssertionError("is not needed here")


def test_cells_of_a_join_add_up(spark, tmp_path, monkeypatch):
    """A batch writes what a join's sides gain, without what they hold; cells of nothing are gone once they are added up."""
    monkeypatch.setattr(store, "MOST_DELTAS", 3)
    e = Engine(spark, str(tmp_path), buckets=2)
    rows, own = numbers(spark, 40), spark.range(8).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"), (F.col("id") * 0.1).alias("f"))
    e.source("s", rows, ["id"])
    e.source("d", own, ["k"])
    e.apply("TRANSFORM t FROM s LEFT JOIN d ON s.g = d.k GROUP BY d.c SELECT SUM(s.v) AS v, COUNT(*) AS n, SUM(d.f) AS f, COUNT(d.f) AS nf")
    e.build()
    e.process({"s": updates(rows.filter("id = 3"), v=F.lit(100))})
    entry = e.store.entry(e.manifest, "t.__p")
    folder, _ = entry.deltas[0]
    late = spark.read.parquet(f"{e.store.root}/{folder}").collect()
    assert [(r["__k0"], r["__n"], int(r["__s0"])) for r in late] == [(3, 0, 91)]
    assert exact(e, "t")
    e.process({"d": deletes(own.filter("k IN (3, 4)"))})
    assert exact(e, "t")
    e.process({"d": inserts(own.filter("k = 3")), "s": deletes(rows.filter("g = 5"))})
    assert exact(e, "t")
    for i in range(4):
        e.process({"s": updates(rows.filter(f"id = {i}").withColumn("v", F.lit(100 if i == 3 else i * 3).cast("bigint")), g=F.lit(i + 4))})
    assert exact(e, "t")
    assert all(len(e.store.entry(e.manifest, f"t.__{s}").deltas) <= 3 for s in "pm")
    monkeypatch.setattr(store, "LEAST_BYTES", 0)
    e.process({"d": deletes(own.filter("k = 1")), "s": deletes(rows.filter("g = 6"))})
    assert exact(e, "t")
    for s in "pm":
        entry = e.store.entry(e.manifest, f"t.__{s}")
        assert not entry.deltas and e.store.read(entry).filter("__n <= 0").isEmpty()


def test_replaced_cells_of_an_earlier_version_are_merged(spark, tmp_path):
    from dataclasses import replace

    e = Engine(spark, str(tmp_path), buckets=2)
    rows, own = numbers(spark, 40), spark.range(8).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    e.source("s", rows, ["id"])
    e.source("d", own, ["k"])
    e.apply("TRANSFORM t FROM s JOIN d ON s.g = d.k GROUP BY d.c SELECT SUM(s.v) AS v, COUNT(*) AS n")
    e.build()
    m = e.manifest
    for s in "pm":  # as they were written: whole cells, the last one of a key counting
        entry = replace(e.store.entry(m, f"t.__{s}"), adds=False)
        e.store.put(m, e.store.change(entry, e.store.read(entry).filter("__k0 = 2").withColumn("__gone", F.lit(False))))
    e._commit(m)
    e.process({"s": deletes(rows.filter("id < 5"))})
    assert exact(e, "t")


def test_a_chain_takes_both_images_from_its_changes(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path), buckets=2)
    rows = numbers(spark, 60)
    e.source("s", rows, ["id"])
    e.apply("TRANSFORM a FROM s GROUP BY g SELECT COUNT(*) AS n, SUM(v) AS v")
    e.apply("TRANSFORM b FROM a SELECT v AS w, n AS n WHERE v > 100")
    e.apply("TRANSFORM c FROM b GROUP BY n SELECT COUNT(*) AS groups, SUM(w) AS w")
    e.build()
    monkeypatch.setattr("deltaloom.streaming.engine.feed", refused)
    for name in ("changed", "upsert"):
        monkeypatch.setattr(store.Store, name, refused)
    e.process({"s": deletes(rows.filter("g = 1 OR id = 2")).unionByName(updates(rows.filter("g = 3"), v=F.lit(0))).unionByName(inserts(rows.filter("g = 4").withColumns({"id": F.col("id") + 100, "g": F.lit(77).cast("bigint")})))})
    assert exact(e, "a", "b", "c") and e.table("b").filter("g IN (1, 3)").isEmpty() and not e.table("b").filter("g = 77").isEmpty()


def test_an_audit_compares_in_one_pass(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path), buckets=2)
    e.source("s", numbers(spark, 30), ["id"])
    e.apply("TRANSFORM t FROM s SELECT v AS v")
    e.build()
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.exceptAll", refused)
    assert e.self_check("t") == {"target": "t", "ok": True, "missing": 0, "extra": 0, "held_keys": 0}
    m = e.manifest
    bad = e.table("t").filter("id <> 4").unionByName(e.table("t").filter("id IN (7, 8)")).withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v")))
    e.store.put(m, e.store.write(e.store.entry(m, "t"), bad))
    e._commit(m)
    assert e.self_check("t") == {"target": "t", "ok": False, "missing": 2, "extra": 3, "held_keys": 0}


def test_a_table_of_fifty_million_rows_is_read_whole(spark, tmp_path):
    e = Engine(spark, str(tmp_path), buckets=28)
    e.source("s", numbers(spark, 50), ["id"])
    entry = e.store.entry(e.manifest, "s")
    assert e.store.touched(entry, numbers(spark, 1)) is None and e.table("s").count() == 50
