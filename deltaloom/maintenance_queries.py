"""Queries about statements, life cycle and batches: what an engine holds after a few steps, and independent SQL for it.

They run over the smaller of the driver's tables, so that what they cost is the steps and not the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.errors import EngineError
from deltaloom.operators.changes import sides
from deltaloom.plans.parser import parse, split_statements
from deltaloom.plans.render import target_select_sql
from deltaloom.session import Session
from deltaloom.sources.changelog import ChangeLog, deletes, inserts, updates
from deltaloom.streaming.engine import Engine

BALANCE = "CAST(c_acctbal AS DECIMAL(18,2))"
AFTER = f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment, {BALANCE} + CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 0 END AS bal FROM customer WHERE c_custkey % 7 <> 0"
VIEW = "TRANSFORM t FROM customer SELECT c_acctbal * 2 AS twice, c_mktsegment AS segment"
TOTALS = "TRANSFORM g FROM customer GROUP BY c_nationkey SELECT COUNT(*) AS n, SUM(c_acctbal) AS total"
GROUPS = "SELECT c_nationkey, count(*) AS n, CAST(sum(bal) AS DOUBLE) AS total FROM ({}) GROUP BY c_nationkey"


def customers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))


def engine_over(spark: SparkSession, rows: DataFrame, *texts: str, name: str = "customer", key: tuple[str, ...] = ("c_custkey",), fuse: int = 1_000_000_000, built: bool = True, **options) -> Engine:
    from deltaloom.queries import workspace

    e = Engine(spark, workspace(spark), buckets=2, fuse=fuse)
    e.source(name, rows, key, **options)
    for t in texts:
        e.apply(t)
    if built:
        e.build()
    return e


def customer_batch(rows: DataFrame) -> dict[str, DataFrame]:
    """Deletions (key % 7 = 0) and raised balances (key % 5 = 0)."""
    return {"customer": deletes(rows.filter("c_custkey % 7 = 0")).unionByName(updates(rows.filter("c_custkey % 7 <> 0 AND c_custkey % 5 = 0"), c_acctbal=F.col("c_acctbal") + 10))}


def doubles(rows: DataFrame) -> DataFrame:
    from deltaloom.queries import shown

    return shown(rows)


STEPS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def step(sql: str):
    """Register a query by its function's name, with the SQL of its rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        STEPS[f.__name__] = (f, sql)
        return f

    return register


# statements


@step(f"SELECT c_custkey, CAST({BALANCE} * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM customer")
def adopted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, customers_of(spark, sf_dir), VIEW)
    e.create_table("kept", e.table("t").schema)
    e.apply(VIEW.replace("TRANSFORM t", "TRANSFORM kept ADOPT EXISTING TABLE"))
    e.build()
    return doubles(e.table("kept"))


@step("SELECT n_name, n_regionkey + 1 AS next FROM nation")
def declared_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), "TRANSFORM t FROM nation KEY (n_name) SELECT n_regionkey + 1 AS next", name="nation", key=("n_nationkey",), unique=[["n_name"]])
    return e.table("t")


@step("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def without_source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, customers_of(spark, sf_dir), "TRANSFORM t FROM customer GROUP BY c_nationkey WITHOUT SOURCE INDEX SELECT COUNT(*) AS n").table("t")


@step(f"SELECT c_custkey, CAST({BALANCE} * 3 AS DOUBLE) AS twice, c_nationkey + 1 AS next FROM customer")
def altered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the fields that are new or changed are built."""
    e = engine_over(spark, customers_of(spark, sf_dir), VIEW)
    e.apply("ALTER TRANSFORM t ADD c_nationkey + 1 AS next, ALTER twice AS c_acctbal * 3, DROP segment")
    return doubles(e.table("t"))


@step(f"SELECT c_custkey, CAST(bal * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM ({AFTER})")
def paused_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    e.apply("PAUSE TRANSFORM t")
    e.process(customer_batch(rows))
    e.apply("RESUME TRANSFORM t")
    return doubles(e.table("t"))


@step(f"SELECT c_custkey, CAST({BALANCE} * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM customer")
def paused_target_keeps_its_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    e.apply("PAUSE TRANSFORM t")
    e.process(customer_batch(rows))
    return doubles(e.table("t"))


@step(f"SELECT c_custkey, CAST({BALANCE} * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0")
def paused_column_keeps_its_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    e.apply("PAUSE TRANSFORM t.twice")
    e.process(customer_batch(rows))
    return doubles(e.table("t"))


@step(f"SELECT c_custkey, CAST(bal * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM ({AFTER})")
def resumed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    e.apply("PAUSE TRANSFORM t.twice")
    e.process(customer_batch(rows))
    e.apply("RESUME TRANSFORM t.twice")
    return doubles(e.table("t"))


@step("SELECT * FROM (VALUES ('drop live', 'TransformNotPaused'), ('drop paused', 'true'), ('drop again', 'false'), ('left', 'g')) v(step, outcome)")
def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, customers_of(spark, sf_dir), VIEW, TOTALS)
    out = []
    try:
        e.apply("DROP TRANSFORM t")
    except EngineError as error:
        out.append(("drop live", error.name))
    e.apply("PAUSE TRANSFORM t")
    out += [(s, str(e.apply("DROP TRANSFORM t")["dropped"]).lower()) for s in ("drop paused", "drop again")]
    return spark.createDataFrame([*out, ("left", ",".join(e.definitions()))], "step string, outcome string")


@step(GROUPS.format(f"SELECT c_nationkey, {BALANCE} AS bal FROM customer WHERE c_custkey > 10"))
def rendered_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a definition is rendered to, run by the SQL engine itself."""
    s = Session().source("customer", customers_of(spark, sf_dir), ["c_custkey"])
    sql = target_select_sql(s.check(TOTALS + " WHERE c_custkey > 10"))
    return doubles(spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=s.frames["customer"]))


@step('SELECT c_custkey, c_nationkey + 1 AS "Next Nation", c_mktsegment AS "select", c_name AS plain FROM customer')
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain names fold to lower case, quoted ones stand as they are."""
    return Session().source("customer", customers_of(spark, sf_dir), ["c_custkey"]).transform('TRANSFORM T FROM Customer SELECT C_NationKey + 1 AS "Next Nation", c_mktsegment AS "select", "c_name" AS PLAIN')


@step("SELECT 't' AS name, 2 AS grammar, TRUE AS same")
def grammar_of_stored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition's text is kept with its grammar's version, and reads back as the same statement."""
    found = engine_over(spark, customers_of(spark, sf_dir), VIEW, built=False).definitions()["t"]
    return spark.createDataFrame([("t", found["grammar"], str(parse(found["text"], found["grammar"])) == found["text"])], "name string, grammar int, same boolean")


@step(GROUPS.format(f"SELECT c_nationkey, {BALANCE} AS bal FROM customer"))
def dumped_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    dump = engine_over(spark, rows, "TRANSFORM t FROM customer SELECT 'a\n;''b' AS odd", TOTALS, built=False).dump_definitions_sql()
    e = engine_over(spark, rows, built=False)
    e.restore_definitions_sql(dump)
    e.build()
    return doubles(e.table("g"))


@step("SELECT * FROM (VALUES ('g', 'CREATE TABLE \"g\" (\"c_nationkey\" integer, \"n\" bigint, \"total\" numeric, UNIQUE (\"c_nationkey\"))')) v(target, statement)")
def dumped_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, customers_of(spark, sf_dir), TOTALS)
    return spark.createDataFrame([("g", s) for s in split_statements(e.schema_dump())], "target string, statement string")


# sources and aggregates


@step("SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def chunked_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source in many buckets, built from and read back."""
    from deltaloom.queries import table, workspace

    e = Engine(spark, workspace(spark), buckets=40)
    e.source("lineitem", table(spark, sf_dir, "lineitem"), ["l_key"], verify=False)
    e.apply("TRANSFORM t FROM lineitem GROUP BY l_returnflag SELECT COUNT(*) AS n, SUM(l_linenumber) AS lines")
    e.build()
    return e.table("t")


@step("SELECT * FROM (SELECT 'unread' AS change, 0::BIGINT AS sides UNION ALL SELECT 'read', count(*) * 2 FROM customer)")
def idle_updates_are_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of updates that touch a column which the definition does not read, and one that it reads."""
    rows = customers_of(spark, sf_dir)
    found = [("unread", updates(rows, c_name=F.lit("x"))), ("read", updates(rows, c_acctbal=F.col("c_acctbal") + 1))]
    return spark.createDataFrame([(k, sides(c, ["c_nationkey", "c_acctbal"]).count()) for k, c in found], "change string, sides bigint")


@step("SELECT * FROM (SELECT c_mktsegment, count(*) AS n, max(c_nationkey) AS top FROM customer GROUP BY c_mktsegment)")
def partitioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "TRANSFORM t FROM customer GROUP BY c_mktsegment SELECT COUNT(*) AS n, MAX(c_nationkey) AS top"
    return engine_over(spark, customers_of(spark, sf_dir), text, partitions=["c_mktsegment"]).table("t")


@step("SELECT c_mktsegment, count(*) AS n, max(c_nationkey) AS top FROM customer WHERE c_mktsegment <> 'BUILDING' AND (c_mktsegment <> 'MACHINERY' OR c_custkey % 2 = 0) GROUP BY c_mktsegment")
def corrected_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition dropped, one replaced."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, "TRANSFORM t FROM customer GROUP BY c_mktsegment SELECT COUNT(*) AS n, MAX(c_nationkey) AS top", partitions=["c_mktsegment"])
    e.correct_partition("customer", {"c_mktsegment": "BUILDING"})
    e.correct_partition("customer", {"c_mktsegment": "MACHINERY"}, rows.filter("c_custkey % 2 = 0"))
    return e.table("t")


@step("SELECT event_type, CAST(sum(user_id % 5) AS BIGINT) AS months, CAST(sum(user_id % 40) AS BIGINT) AS days, CAST(sum(event_id * 1000003) AS BIGINT) AS micros FROM events GROUP BY event_type")
def interval_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals are summed field by field."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = F.struct((F.col("user_id") % 5).cast("int").alias("months"), (F.col("user_id") % 40).cast("int").alias("days"), (F.col("event_id") * 1000003).cast("bigint").alias("micros"))
    s = Session().source("spans", rows.select("event_id", "event_type", span.alias("span")), ["event_id"])
    got = s.transform("TRANSFORM t FROM spans GROUP BY event_type SELECT SUM(span) AS total")
    return got.select("event_type", *[F.col(f"total.{p}").cast("bigint").alias(p) for p in ("months", "days", "micros")])


@step(f"SELECT c_nationkey, CAST(coalesce(sum(bal), 0) + count(*) AS DOUBLE) AS mixed, count(*) * 2 - count(c_name) AS odd, sum(bal) > 10000 AS rich FROM (SELECT *, {BALANCE} AS bal FROM customer) GROUP BY c_nationkey")
def composed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "TRANSFORM t FROM customer GROUP BY c_nationkey SELECT COALESCE(SUM(c_acctbal), 0) + COUNT(*) AS mixed, COUNT(*) * 2 - COUNT(c_name) AS odd, SUM(c_acctbal) > 10000 AS rich"
    return doubles(Session().source("customer", customers_of(spark, sf_dir), ["c_custkey"]).transform(text))


@step("SELECT c_custkey, c_mktsegment = 'BUILDING' AS building FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    labels = tuple(r[0] for r in rows.select("c_mktsegment").distinct().collect())
    s = Session().source("customer", rows, ["c_custkey"], types={"c_mktsegment": "enum"}, labels={"c_mktsegment": labels})
    return s.transform("TRANSFORM t FROM customer SELECT c_mktsegment = 'BUILDING' AS building WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")


# batches


@step(f"SELECT c_custkey, CAST({BALANCE} * 2 AS DOUBLE) AS twice, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 2")
def read_again_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes without images read the row as it is, and never win over a deletion."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    m = e.manifest
    e.store.put(m, e.store.write(e.store.entry(m, "t"), e.table("t").withColumn("twice", F.lit(0))))
    e._commit(m)
    again = deletes(rows).withColumn("op", F.lit("recompute"))
    e.process({"customer": again.unionByName(deletes(rows.filter("c_custkey % 4 = 2")))})
    return doubles(e.table("t"))


@step(GROUPS.format(AFTER))
def replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes a second time under its number changes nothing."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, TOTALS)
    for _ in range(2):
        e.process(customer_batch(rows), batch_id=7)
    return doubles(e.table("g"))


@step(GROUPS.format(f"SELECT c_nationkey, {BALANCE} AS bal FROM customer"))
def rebuilt_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, customers_of(spark, sf_dir), VIEW, "TRANSFORM g FROM customer GROUP BY c_nationkey SELECT COUNT(*) AS n, SUM(c_acctbal) AS total")
    m = e.manifest
    e.store.put(m, e.store.write(e.store.entry(m, "g"), e.store.read(e.store.entry(m, "g")).filter("c_nationkey > 5")))
    e._commit(m)
    e.request_backfill("customer")
    return doubles(e.table("g"))


@step("SELECT * FROM (VALUES ('token', 2), ('reached', 2), ('pending', 0)) v(what, position)")
def awaited_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, TOTALS)
    log = ChangeLog(e)
    for part in (rows.filter("c_custkey % 7 = 0"), rows.filter("c_custkey % 7 = 1")):
        log.append({"customer": deletes(part)})
    token = e.watermark_token()
    log.drain()
    return spark.createDataFrame([("token", token), ("reached", e.await_converged(token)), ("pending", len(log.pending()))], "what string, position int")


@step(GROUPS.format(f"SELECT c_nationkey, {BALANCE} AS bal FROM customer WHERE c_custkey % 3 <> 0"))
def streamed_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, one commit to a batch."""
    rows = customers_of(spark, sf_dir).filter("c_custkey % 3 <> 2")
    e = engine_over(spark, rows, TOTALS)
    log = ChangeLog(e)
    log.append({"customer": deletes(rows.filter("c_custkey % 3 = 0"))})
    log.append({"customer": inserts(customers_of(spark, sf_dir).filter("c_custkey % 3 = 2"))})
    q = log.stream(f"{e.store.root}/stream", most=1, available_now=True)
    q.awaitTermination()
    return doubles(e.table("g"))


@step(f"SELECT c_custkey, CAST({BALANCE} * 2 + 6 AS DOUBLE) AS twice, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 1")
def late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one key in any order: position and change number say which is last."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW)
    at = lambda c, seq, n: c.withColumns({"seq": F.lit(seq).cast("bigint"), "change_id": F.lit(n).cast("bigint")})
    one, two = (rows.withColumn("c_acctbal", (F.col("c_acctbal") + n).cast("decimal(12,2)")) for n in (1, 2))
    steps = [at(updates(two, c_acctbal=F.col("c_acctbal") + 1), 5, 9), at(updates(rows, c_acctbal=F.col("c_acctbal") + 1), 3, 20), at(updates(one, c_acctbal=F.col("c_acctbal") + 1), 5, 2)]
    last = at(deletes(rows.filter("c_custkey % 2 = 0").withColumn("c_acctbal", (F.col("c_acctbal") + 3).cast("decimal(12,2)"))), 6, 1)
    e.process({"customer": last.unionByName(steps[0]).unionByName(steps[1]).unionByName(steps[2])})
    return doubles(e.table("t"))


WIDE = "TRANSFORM t FROM customer SELECT " + ", ".join(f"c_nationkey + {i} AS f{i}" for i in range(30)) + ", c_acctbal / (c_nationkey - 3.0) AS ratio"


@step("SELECT 't' AS transform, c_custkey, 'ratio' AS field, '22012' AS state FROM customer WHERE c_nationkey = 3")
def quarantine_of_a_wide_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, customers_of(spark, sf_dir), WIDE)
    return e.quarantined("t").select("transform", F.get_json_object("key", "$.c_custkey").cast("bigint").alias("c_custkey"), "field", "state")


@step("SELECT c_custkey, c_nationkey AS f0, c_nationkey + 29 AS f29 FROM customer WHERE c_nationkey <> 3")
def wide_target_without_held_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, customers_of(spark, sf_dir), WIDE).table("t").select("c_custkey", "f0", "f29")


@step("SELECT * FROM (VALUES ('live', 'ratio')) v(status, paused)")
def fuse_pauses_a_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many failures of one column stop the column, and not the transform."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows.filter("c_nationkey <> 3"), "TRANSFORM t FROM customer SELECT c_acctbal / (c_nationkey - 3.0) AS ratio, c_name AS name", fuse=2)
    e.process({"customer": inserts(rows.filter("c_nationkey = 3"))})
    return spark.createDataFrame([(e.status("t")["status"], ",".join(e.status("t")["paused_columns"]))], "status string, paused string")


@step("SELECT * FROM (VALUES (1, 'waiting_to_backfill'), (2, 'live'), (3, 'catching_up'), (4, 'live'), (5, 'paused'), (6, 'live'), (7, 'quarantined')) v(step, status)")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows.filter("c_nationkey <> 3"), "TRANSFORM g FROM customer GROUP BY c_mktsegment SELECT SUM(c_acctbal / (c_nationkey - 3.0)) AS total", fuse=2, built=False)
    seen = [e.status("g")["status"]]
    log = ChangeLog(e)
    for f in (e.build, lambda: log.append({"customer": deletes(rows.filter("c_custkey = 1"))}), log.drain, lambda: e.apply("PAUSE TRANSFORM g"), lambda: e.apply("RESUME TRANSFORM g"), lambda: e.process({"customer": inserts(rows.filter("c_nationkey = 3"))})):
        f()
        seen.append(e.status("g")["status"])
    return spark.createDataFrame(list(enumerate(seen, 1)), "step int, status string")


@step("SELECT * FROM (SELECT 'deltaloom_changes_total' AS name, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 5 = 0)::DOUBLE AS value FROM customer UNION ALL SELECT * FROM (VALUES ('deltaloom_batches_total', 1), ('deltaloom_builds_total', 2), ('deltaloom_definitions', 2), ('deltaloom_paused_definitions', 0), ('deltaloom_pending_commits', 0)) v)")
def counted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, VIEW, TOTALS)
    e.process(customer_batch(rows))
    wanted = {f"deltaloom_{n}" for n in ("changes_total", "batches_total", "builds_total", "definitions", "paused_definitions", "pending_commits")}
    found = [(n, float(v)) for n, v in (x.rsplit(" ", 1) for x in e.metrics().splitlines()) if n in wanted]
    return spark.createDataFrame(found, "name string, value double")


@step(f"SELECT c_nationkey, count(*) AS n, CAST(sum({BALANCE}) AS DOUBLE) AS total FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey")
def rebuilt_on_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that loses one column and gets another type for one; what reads it still holds and is rebuilt."""
    rows = customers_of(spark, sf_dir)
    e = engine_over(spark, rows, TOTALS)
    now = rows.filter("c_custkey % 2 = 0").drop("c_name").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))
    e.process({"customer": inserts(now)})
    e.replace_source("customer", now)
    return doubles(e.table("g").withColumn("c_nationkey", F.col("c_nationkey").cast("int")))


@step("SELECT * FROM (VALUES ('t', 'done', TRUE)) v(target, status, ok)")
def audited_in_the_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    import time

    e = engine_over(spark, customers_of(spark, sf_dir), VIEW)
    job = e.start_self_check("t")
    while e.self_check_job(job)["status"] == "running":
        time.sleep(0.2)
    got = e.self_check_job(job)
    return spark.createDataFrame([(got["target"], got["status"], got["result"]["ok"])], "target string, status string, ok boolean")


# refusals

DEEP = "TRANSFORM t FROM orders SELECT " + "(" * 120 + "o_custkey" + ")" * 120 + " AS x"
REFUSED = (
    (DEEP, "ExpressionTooDeep"),
    ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey > customer.c_custkey SELECT customer.c_name AS x", "UnexpectedToken"),
    ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = 1 SELECT customer.c_name AS x", "UnexpectedToken"),
    ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey JOIN nation ON customer.c_nationkey = nation.n_nationkey SELECT nation.n_name AS x", "JoinOnReadsAnotherJoinedTable"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT COUNT(*) AS x HAVING COUNT(*) > 1", "UnexpectedToken"),
    ("TRANSFORM t FROM orders GROUP BY ROLLUP (o_custkey) SELECT COUNT(*) AS x", "UnexpectedToken"),
    ("TRANSFORM t FROM orders SELECT o_custkey < o_orderkey < 5 AS x", "NonAssociativeComparison"),
    ("TRANSFORM t FROM orders SELECT CASE o_custkey WHEN 1 THEN 2 END AS x", "SimpleCaseUnsupported"),
    ("TRANSFORM t FROM orders SELECT o_custkey IN (SELECT c_custkey FROM customer) AS x", "SubqueryInList"),
    ("TRANSFORM t FROM orders SELECT EXTRACT(julian FROM o_orderdate) AS x", "TemporalLiteral"),
    ("TRANSFORM t FROM orders SELECT EXTRACT(timezone FROM o_orderdate) AS x", "TemporalLiteral"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT SUM(o_totalprice) OVER () AS x", "UnsupportedFunction"),
    ("TRANSFORM t FROM orders SELECT o_custkey AS x UNION SELECT 1", "UnexpectedToken"),
    ("TRANSFORM t FROM orders SELECT DISTINCT o_custkey AS x", "UnexpectedToken"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT APPROX_COUNT_DISTINCT(o_orderkey) AS x", "UnsupportedFunction"),
    ("TRANSFORM t FROM orders SELECT ARRAY[1] AS x", "UnexpectedChar"),
    ("TRANSFORM t FROM orders SELECT o_custkey AS x LIMIT 5", "UnexpectedToken"),
    ("TRANSFORM t FROM orders SELECT o_custkey BETWEEN SYMMETRIC 1 AND 2 AS x", "BetweenSymmetric"),
    ("TRANSFORM t FROM orders SELECT o_custkey = ANY (1) AS x", "QuantifiedComparison"),
)


def syntax_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with what the language leaves out, each with the error's name."""
    from deltaloom.queries import KEYS, table

    s = Session()
    for name in ("orders", "customer", "nation"):
        s.source(name, table(spark, sf_dir, name), KEYS[name])

    def outcome(text: str) -> str:
        try:
            s.check(text)
            return "none"
        except EngineError as e:
            return e.name

    return spark.createDataFrame([(t, outcome(t)) for t, _ in REFUSED], "statement string, error string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in STEPS.items()} | {"syntax_refusals": syntax_refusals}


def oracle_sql(values: Callable[..., str]) -> dict[str, str]:
    return {n: sql for n, (_, sql) in STEPS.items()} | {"syntax_refusals": partial(values, REFUSED, "statement, error")()}
