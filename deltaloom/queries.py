"""Queries over the driver's tables, one or more for each operator, and independent SQL for each.

Money columns are doubles that hold cents, so both sides cast them to decimals first. Results show decimals as doubles
and dates and times as text, so that two engines' values can be compared.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom import maintenance_queries
from deltaloom.errors import EngineError
from deltaloom.plans.parser import statement_kind
from deltaloom.session import Session
from deltaloom.sources.changelog import ChangeLog, deletes, inserts, truncate, updates
from deltaloom.streaming.engine import Engine

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_key"],
    "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
MONEY = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with money as decimals; lineitem, which has no key, gets one of all its columns."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = rows
    rows = rows.withColumns({c: F.col(c).cast("decimal(12,2)") for c in rows.columns if c in MONEY})
    return rows.withColumn("l_key", F.xxhash64(*plain.columns)) if name == "lineitem" else rows


def shown(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[F.col(f"`{n}`").cast("double" if isinstance(t, T.DecimalType) else "string" if isinstance(t, (T.DateType, T.TimestampNTZType, T.TimestampType)) else t).alias(n) for n, t in kinds.items() if n != "l_key"])


def over(spark: SparkSession, sf_dir: str, *texts: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """The last of some definitions over the driver's tables (or ``frames`` in their place)."""
    s, out = Session(), None
    read = " ".join(texts)
    for name, key in KEYS.items():
        if name in read:
            s.source(name, (frames or {}).get(name, table(spark, sf_dir, name)), key)
    for t in texts:
        out = s.transform(t)
    return shown(out)


CENTS = "CAST(o_totalprice AS DECIMAL(18,2))"

#: name: (definitions, SQL)
PLAIN: dict[str, tuple[tuple[str, ...], str]] = {
    "one_to_one_projection": (
        ("TRANSFORM t FROM orders SELECT o_totalprice * 2 AS twice, orders.o_custkey + 1 AS next_cust, o_orderstatus AS status, -o_totalprice AS minus",),
        f"SELECT o_orderkey, CAST({CENTS} * 2 AS DOUBLE) AS twice, o_custkey + 1 AS next_cust, o_orderstatus AS status, CAST(-{CENTS} AS DOUBLE) AS minus FROM orders",
    ),
    "one_to_one_where": (
        ("TRANSFORM t FROM orders SELECT o_custkey AS cust WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderkey % 3 = 1 AND NOT o_orderpriority = '1-URGENT'",),
        f"SELECT o_orderkey, o_custkey AS cust FROM orders WHERE o_orderstatus IN ('O', 'F') AND {CENTS} BETWEEN 1000 AND 200000 AND o_orderkey % 3 = 1 AND NOT o_orderpriority = '1-URGENT'",
    ),
    "field_reads_field": (
        ("TRANSFORM t FROM orders SELECT o_totalprice + 1 AS a, a * 2 AS b, a + b AS c, c > 1000 AS big",),
        f"SELECT o_orderkey, CAST({CENTS} + 1 AS DOUBLE) AS a, CAST(({CENTS} + 1) * 2 AS DOUBLE) AS b, CAST(({CENTS} + 1) * 3 AS DOUBLE) AS c, ({CENTS} + 1) * 3 > 1000 AS big FROM orders",
    ),
    "case_coalesce_nullif": (
        ("TRANSFORM t FROM orders SELECT CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE NULL END AS band, COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS status, NULLIF(o_custkey, 1) AS cust",),
        f"SELECT o_orderkey, CASE WHEN {CENTS} > 100000 THEN 'high' WHEN {CENTS} > 50000 THEN 'mid' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, nullif(o_custkey, 1) AS cust FROM orders",
    ),
    "null_logic": (
        ("TRANSFORM t FROM orders SELECT NULLIF(o_orderstatus, 'O') AS s, o_custkey NOT IN (2, NULL) AS not_in, NULLIF(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS apart, NULLIF(o_orderstatus, 'O') = 'F' AND FALSE AS no, (NULLIF(o_orderstatus, 'O') = 'F') IS NULL AS unknown, NULLIF(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS same",),
        "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s, o_custkey NOT IN (2, NULL) AS not_in, nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS apart, nullif(o_orderstatus, 'O') = 'F' AND FALSE AS no, (nullif(o_orderstatus, 'O') = 'F') IS NULL AS unknown, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS same FROM orders",
    ),
    "text_functions": (
        ("TRANSFORM t FROM documents SELECT STRPOS(text, 'a') AS first_a, CHAR_LENGTH(text) AS chars, OCTET_LENGTH(text) AS bytes, REGEXP_COUNT(text, '[0-9]+') AS numbers, lang = 'en' AS english",),
        "SELECT doc_id, CAST(strpos(text, 'a') AS INT) AS first_a, CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS bytes, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS numbers, lang = 'en' AS english FROM documents",
    ),
    "text_functions_part": (
        ("TRANSFORM t FROM part SELECT STRPOS(p_type, p_brand) AS at, CHAR_LENGTH(p_name) + OCTET_LENGTH(p_brand) AS size, COALESCE(p_name, p_type) AS name",),
        "SELECT p_partkey, CAST(strpos(p_type, p_brand) AS INT) AS at, CAST(length(p_name) + strlen(p_brand) AS INT) AS size, p_name AS name FROM part",
    ),
    "math_functions": (
        ("TRANSFORM t FROM customer SELECT ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, ROUND(c_acctbal, -2) AS r2, TRUNC(c_acctbal) AS t, TRUNC(c_acctbal, 1) AS t1, c_acctbal % 7 AS m, c_custkey % -7 AS mi",),
        """SELECT c_custkey, CAST(abs(x) AS DOUBLE) AS a, CAST(ceil(x) AS DOUBLE) AS c, CAST(floor(x) AS DOUBLE) AS f, CAST(sign(x) * floor(abs(x) + 0.5) AS DOUBLE) + 0 AS r,
        CAST(sign(x) * floor(abs(x) * 10 + 0.5) AS DOUBLE) / 10 + 0 AS r1, CAST(sign(x) * floor(abs(x) / 100 + 0.5) AS DOUBLE) * 100 + 0 AS r2, CAST(sign(x) * floor(abs(x)) AS DOUBLE) + 0 AS t,
        CAST(sign(x) * floor(abs(x) * 10) AS DOUBLE) / 10 + 0 AS t1, CAST(x % 7 AS DOUBLE) AS m, c_custkey % -7 AS mi FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS x FROM customer)""",
    ),
    "float_arithmetic": (
        ("TRANSFORM t FROM events SELECT value * 2 AS twice, value / DOUBLE PRECISION '3' AS third, value + 1 AS plus, value - user_id AS less, value > 0.5 AS more, CEIL(value) AS up, FLOOR(value) AS down, TRUNC(value) AS cut, ABS(value) AS size",),
        "SELECT event_id, value * 2 AS twice, value / 3 AS third, value + 1 AS plus, value - user_id AS less, value > 0.5 AS more, ceil(value) AS up, floor(value) AS down, trunc(value) AS cut, abs(value) AS size FROM events",
    ),
    "numeric_division": (
        ("TRANSFORM t FROM orders SELECT o_totalprice / 3 AS third, o_totalprice / NULLIF(o_custkey, 0) AS per, o_totalprice * o_totalprice AS square",),
        f"SELECT o_orderkey, CAST((x * 20000 + 3) // 6 AS DOUBLE) / 1000000 AS third, CAST((x * 20000 + k) // (2 * k) AS DOUBLE) / 1000000 AS per, CAST(p * p AS DOUBLE) AS square FROM (SELECT o_orderkey, {CENTS} AS p, CAST({CENTS} * 100 AS HUGEINT) AS x, nullif(o_custkey, 0) AS k FROM orders)",
    ),
    "date_trunc_units": (
        ("TRANSFORM t FROM orders SELECT " + ", ".join(f"DATE_TRUNC('{u}', o_orderdate) AS u_{u}" for u in ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")),),
        "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS VARCHAR) AS u_{u}" for u in ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year"))
        + ", CAST(make_timestamp(CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT), 1, 1, 0, 0, 0) AS VARCHAR) AS u_decade"
        + ", CAST(make_timestamp(CAST(floor((year(o_orderdate) + 99) / 100) * 100 - 99 AS BIGINT), 1, 1, 0, 0, 0) AS VARCHAR) AS u_century"
        + ", CAST(make_timestamp(CAST(floor((year(o_orderdate) + 999) / 1000) * 1000 - 999 AS BIGINT), 1, 1, 0, 0, 0) AS VARCHAR) AS u_millennium FROM orders",
    ),
    "extract_fields": (
        ("TRANSFORM t FROM events SELECT " + ", ".join(f"EXTRACT({f} FROM ts) AS e_{f}" for f in ("year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "isoyear", "decade", "century", "millennium", "epoch", "hour", "minute", "second", "milliseconds", "microseconds")),),
        "SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS DOUBLE) AS e_{f}" for f in ("year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "isoyear", "decade", "century", "millennium", "hour", "minute", "microseconds"))
        + ", CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS e_epoch, CAST(extract(microseconds FROM ts) AS DOUBLE) / 1000000 AS e_second, CAST(extract(microseconds FROM ts) AS DOUBLE) / 1000 AS e_milliseconds FROM events",
    ),
    "date_arithmetic": (
        ("TRANSFORM t FROM days SELECT day + 30 AS later, day - 1 AS before, 7 + day AS week, day - DATE '2000-01-01' AS days, day > DATE '1995-06-15' AS late, EXTRACT(doy FROM day) AS doy, EXTRACT(epoch FROM day) AS epoch",),
        "SELECT o_orderkey, CAST(d + 30 AS VARCHAR) AS later, CAST(d - 1 AS VARCHAR) AS before, CAST(d + 7 AS VARCHAR) AS week, CAST(d - DATE '2000-01-01' AS INT) AS days, d > DATE '1995-06-15' AS late, CAST(extract(doy FROM d) AS DOUBLE) AS doy, CAST(epoch(d) AS DOUBLE) AS epoch FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
    ),
    "at_time_zone_utc": (
        ("TRANSFORM t FROM instants SELECT tz AT TIME ZONE 'UTC' AS plain, DATE_TRUNC('hour', tz AT TIME ZONE 'UTC') AS hour",),
        "SELECT event_id, CAST(ts AS VARCHAR) AS plain, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour FROM events",
    ),
    "casts": (
        ("TRANSFORM t FROM part SELECT CAST(p_size AS bigint) AS big, CAST(p_size AS numeric) / 3 AS third, CAST(p_partkey AS int8) + 1 AS next, CAST(NULL AS date) AS none, CAST(p_retailprice AS decimal) AS same",),
        "SELECT p_partkey, CAST(p_size AS BIGINT) AS big, CAST(round(CAST(p_size AS DOUBLE) / 3, 6) AS DOUBLE) AS third, p_partkey + 1 AS next, CAST(NULL AS VARCHAR) AS none, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS same FROM part",
    ),
    "typed_literals": (
        ("TRANSFORM t FROM nation SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 12:30:00.5' AS ts, DOUBLE PRECISION '1.5' AS f, OID '7' AS o, INET '10.0.0.1' AS ip, VARBIT '101' AS bits, JSONB '{\"a\": 1}' AS j, 2147483648 AS big, -2147483648 AS low, 1.50 AS n, 'it''s' AS s, TRUE AS yes",),
        "SELECT n_nationkey, '2024-02-29' AS d, '2024-02-29 12:30:00.5' AS ts, CAST(1.5 AS DOUBLE) AS f, CAST(7 AS BIGINT) AS o, '10.0.0.1' AS ip, '101' AS bits, '{\"a\": 1}' AS j, CAST(2147483648 AS BIGINT) AS big, CAST(-2147483648 AS INT) AS low, CAST(1.5 AS DOUBLE) AS n, 'it''s' AS s, TRUE AS yes FROM nation",
    ),
    "agg_count_sum_avg": (
        ("TRANSFORM t FROM lineitem GROUP BY l_returnflag, l_linestatus SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, SUM(l_extendedprice) AS price, SUM(l_extendedprice * (1 - l_discount)) AS net, AVG(l_quantity) AS qty, SUM(l_linenumber) AS lines, SUM(l_partkey) AS parts, COALESCE(SUM(l_tax), 0) + COUNT(*) AS mixed",),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, count(t) AS nt, CAST(sum(p) AS DOUBLE) AS price, CAST(sum(p * (1 - d)) AS DOUBLE) AS net, round(CAST(sum(q) AS DOUBLE) / count(q), 6) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_partkey) AS DOUBLE) AS parts, CAST(sum(t) + count(*) AS DOUBLE) AS mixed FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(18,2)) AS d, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_tax AS DECIMAL(18,2)) AS t FROM lineitem) GROUP BY ALL",
    ),
    "agg_orders_by_customer": (
        ("TRANSFORM customer_totals FROM orders GROUP BY o_custkey SELECT o_custkey AS o_custkey, COUNT(*) AS order_count, SUM(o_totalprice) AS total",),
        f"SELECT o_custkey, count(*) AS order_count, CAST(sum({CENTS}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey",
    ),
    "agg_min_max": (
        ("TRANSFORM t FROM events GROUP BY event_type SELECT MIN(value) AS low, MAX(value) AS high, MIN(ts) AS first, MAX(ts) AS last, MIN(user_id) AS least, COUNT(*) AS n",),
        "SELECT event_type, min(value) AS low, max(value) AS high, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, min(user_id) AS least, count(*) AS n FROM events GROUP BY event_type",
    ),
    "agg_where": (
        ("TRANSFORM t FROM orders GROUP BY o_orderpriority SELECT COUNT(*) AS n, SUM(o_totalprice) AS total WHERE o_orderstatus = 'F'",),
        f"SELECT o_orderpriority, count(*) AS n, CAST(sum({CENTS}) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    ),
    "agg_case_conditional": (
        ("TRANSFORM t FROM orders GROUP BY o_orderpriority SELECT COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS nf, SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS open",),
        f"SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS nf, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {CENTS} ELSE 0 END) AS DOUBLE) AS open FROM orders GROUP BY o_orderpriority",
    ),
    "agg_float_sum": (
        ("TRANSFORM t FROM events GROUP BY event_type SELECT SUM(value) AS total, AVG(value) AS mean, COUNT(value) AS n",),
        "SELECT event_type, fsum(value) AS total, fsum(value) / count(value) AS mean, count(value) AS n FROM events GROUP BY event_type",
    ),
    "agg_null_group": (
        ("TRANSFORM a FROM orders SELECT NULLIF(o_orderstatus, 'O') AS s, o_totalprice AS p", "TRANSFORM t FROM a GROUP BY s SELECT COUNT(*) AS n, SUM(p) AS total"),
        f"SELECT nullif(o_orderstatus, 'O') AS s, count(*) AS n, CAST(sum({CENTS}) AS DOUBLE) AS total FROM orders GROUP BY 1",
    ),
    "join_inner_group_by": (
        ("TRANSFORM t FROM orders AS o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment SELECT c.c_mktsegment AS c_mktsegment, SUM(o.o_totalprice) AS total, COUNT(*) AS n, AVG(c.c_acctbal) AS bal",),
        f"SELECT c_mktsegment, CAST(sum({CENTS}) AS DOUBLE) AS total, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal), 6) AS bal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "join_left_group_by": (
        ("TRANSFORM t FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY labels.quality, documents.lang SELECT COUNT(*) AS n, SUM(documents.n_chars) AS chars, COUNT(labels.toxic) AS labelled, SUM(labels.toxic) AS toxic",),
        "SELECT quality, lang, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) AS chars, count(toxic) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality, lang",
    ),
    "join_composite_on": (
        ("TRANSFORM pairs FROM lineitem GROUP BY l_orderkey, l_linenumber SELECT COUNT(*) AS copies", "TRANSFORM t FROM lineitem JOIN pairs ON lineitem.l_orderkey = pairs.l_orderkey AND lineitem.l_linenumber = pairs.l_linenumber GROUP BY pairs.copies SELECT COUNT(*) AS n, SUM(lineitem.l_extendedprice) AS total"),
        "SELECT copies, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL) USING (l_orderkey, l_linenumber) GROUP BY copies",
    ),
    "join_where_split": (
        ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_nationkey, orders.o_orderstatus SELECT SUM(orders.o_totalprice) AS total, COUNT(*) AS n WHERE orders.o_totalprice > 50000 AND customer.c_mktsegment IN ('BUILDING', 'MACHINERY')",),
        f"SELECT c_nationkey, o_orderstatus, CAST(sum({CENTS}) AS DOUBLE) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE {CENTS} > 50000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL",
    ),
    "one_to_one_join_left": (
        ("TRANSFORM t FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id SELECT labels.quality AS quality, COALESCE(labels.toxic, -1) AS toxic, documents.lang AS lang",),
        "SELECT d.doc_id, quality, coalesce(toxic, -1) AS toxic, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "one_to_one_join_inner": (
        ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey SELECT customer.c_name AS name, orders.o_totalprice + customer.c_acctbal AS sum WHERE customer.c_acctbal > 0 AND orders.o_totalprice > customer.c_acctbal",),
        f"SELECT o_orderkey, c_name AS name, CAST({CENTS} + CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS sum FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > c_acctbal",
    ),
    "one_to_one_join_anti": (
        ("TRANSFORM t FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id SELECT documents.source AS source WHERE labels.doc_id IS NULL",),
        "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)",
    ),
    "star_join": (
        ("TRANSFORM t FROM lineitem AS l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN orders o ON l.l_orderkey = o.o_orderkey SELECT l.l_linenumber AS line, p.p_brand AS brand, s.s_name AS supplier, o.o_orderdate AS day, l.l_quantity * p.p_retailprice AS worth",),
        "SELECT l_linenumber AS line, p_brand AS brand, s_name AS supplier, CAST(o_orderdate AS VARCHAR) AS day, CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS worth FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey",
    ),
    "chain_distinct_count": (
        ("TRANSFORM g_x FROM events GROUP BY event_type, user_id SELECT COUNT(*) AS n", "TRANSFORM g_distinct FROM g_x GROUP BY event_type SELECT COUNT(user_id) AS users, SUM(n) AS n"),
        "SELECT event_type, count(DISTINCT user_id) AS users, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type",
    ),
    "chain_time_bucket": (
        ("TRANSFORM b FROM events SELECT DATE_TRUNC('day', ts) AS bucket, value AS value", "TRANSFORM t FROM b GROUP BY bucket SELECT COUNT(*) AS n, COUNT(value) AS values"),
        "SELECT CAST(date_trunc('day', ts)::TIMESTAMP AS VARCHAR) AS bucket, count(*) AS n, count(value) AS values FROM events GROUP BY 1",
    ),
    "chain_having": (
        ("TRANSFORM a FROM orders GROUP BY o_custkey SELECT SUM(o_totalprice) AS total", "TRANSFORM big FROM a SELECT total AS total WHERE total > 500000"),
        f"SELECT o_custkey, CAST(sum({CENTS}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING sum({CENTS}) > 500000",
    ),
}


def plain(name: str) -> Callable[[SparkSession, str], DataFrame]:
    texts = PLAIN[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "date_arithmetic":
            days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
            return shown(Session().source("days", days, ["o_orderkey"]).transform(texts[0]))
        if name == "at_time_zone_utc":
            instants = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("tz"))
            return shown(Session().source("instants", instants, ["event_id"]).transform(texts[0]))
        return over(spark, sf_dir, *texts)

    return run


# maintenance


def workspace(spark: SparkSession) -> str:
    """A new folder on storage that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/engine-{uuid.uuid4().hex}"


def order_changes(orders: DataFrame) -> list[DataFrame]:
    """Two commits: deletions (key % 7 = 0) with updates (key % 5 = 0), then new orders (of key % 11 = 0, key + 10,000,000) with moves to another customer (key % 13 = 1)."""
    left = orders.filter("o_orderkey % 7 <> 0")
    raised = left.filter("o_orderkey % 5 = 0")
    first = deletes(orders.filter("o_orderkey % 7 = 0")).unionByName(updates(raised, o_totalprice=F.col("o_totalprice") + 10, o_orderstatus=F.lit("P")))
    now = left.filter("o_orderkey % 5 <> 0").unionByName(raised.withColumns({"o_totalprice": (F.col("o_totalprice") + 10).cast("decimal(12,2)"), "o_orderstatus": F.lit("P")}))
    new = orders.filter("o_orderkey % 11 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return [first, inserts(new).unionByName(updates(now.filter("o_orderkey % 13 = 1"), o_custkey=F.col("o_custkey") % 10 + 1))]


ORDERS_AFTER = """WITH o AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 1 THEN o_custkey % 10 + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
           CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 0 END AS price, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0
)"""


def customer_changes(customers: DataFrame) -> DataFrame:
    """Deletions (key % 9 = 0) and moves to another segment (key % 4 = 1)."""
    return deletes(customers.filter("c_custkey % 9 = 0")).unionByName(updates(customers.filter("c_custkey % 9 <> 0 AND c_custkey % 4 = 1"), c_mktsegment=F.lit("MOVED")))


CUSTOMERS_AFTER = "c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 1 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer WHERE c_custkey % 9 <> 0)"


def maintained(spark: SparkSession, sf_dir: str, *texts: str, customers: bool = False, emptied: bool = False, log: bool = False) -> Engine:
    """An engine over orders (and customers) that has built the definitions and applied the changes batch by batch."""
    e = Engine(spark, workspace(spark))
    orders = table(spark, sf_dir, "orders")
    e.source("orders", orders, ["o_orderkey"])
    batches: list[dict[str, DataFrame]] = [{"orders": x} for x in order_changes(orders)]
    if customers:
        own = table(spark, sf_dir, "customer")
        e.source("customer", own, ["c_custkey"])
        batches[1]["customer"] = customer_changes(own)
    if emptied:
        batches.append({"orders": truncate(orders)})
        batches.append({"orders": inserts(orders.filter("o_orderkey % 2 = 0"))})
    for t in texts:
        e.apply(t)
    e.build()
    changelog = ChangeLog(e)
    for b in batches:
        if log:
            changelog.append(b)
        else:
            e.process(b)
    if log:
        changelog.drain(1)
    return e


def target(*texts: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """The last definition's target after the changes."""
    return lambda spark, sf_dir: shown(maintained(spark, sf_dir, *texts, **options).table(texts[-1].split()[1]))


DELTA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "delta_one_to_one": (
        target("TRANSFORM t FROM orders SELECT o_totalprice * 2 AS twice, o_orderstatus AS status WHERE o_orderstatus IN ('O', 'P')"),
        f"{ORDERS_AFTER} SELECT o_orderkey, CAST(price * 2 AS DOUBLE) AS twice, o_orderstatus AS status FROM o WHERE o_orderstatus IN ('O', 'P')",
    ),
    "delta_aggregate": (
        target("TRANSFORM t FROM orders GROUP BY o_custkey SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean", log=True),
        f"{ORDERS_AFTER} SELECT o_custkey, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total, round(CAST(sum(price) AS DOUBLE) / count(*), 6) AS mean FROM o GROUP BY o_custkey",
    ),
    "delta_min_max_retract": (
        target("TRANSFORM t FROM orders GROUP BY o_custkey SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MAX(o_orderdate) AS last, COUNT(*) AS n"),
        f"{ORDERS_AFTER} SELECT o_custkey, CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high, CAST(max(o_orderdate) AS VARCHAR) AS last, count(*) AS n FROM o GROUP BY o_custkey",
    ),
    "delta_join": (
        target("TRANSFORM t FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment, orders.o_orderstatus SELECT SUM(orders.o_totalprice) AS total, COUNT(*) AS n, COUNT(customer.c_acctbal) AS matched, SUM(customer.c_acctbal) AS bal", customers=True),
        f"{ORDERS_AFTER}, {CUSTOMERS_AFTER} SELECT c_mktsegment, o_orderstatus, CAST(sum(price) AS DOUBLE) AS total, count(*) AS n, count(bal) AS matched, CAST(sum(bal) AS DOUBLE) AS bal FROM o LEFT JOIN c ON o_custkey = c_custkey GROUP BY ALL",
    ),
    "delta_one_to_one_join": (
        target("TRANSFORM t FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey SELECT customer.c_name AS name, customer.c_mktsegment AS segment, orders.o_totalprice + COALESCE(customer.c_acctbal, 0) AS sum", customers=True),
        f"{ORDERS_AFTER}, {CUSTOMERS_AFTER} SELECT o_orderkey, c_name AS name, c_mktsegment AS segment, CAST(price + coalesce(bal, 0) AS DOUBLE) AS sum FROM o LEFT JOIN c ON o_custkey = c_custkey",
    ),
    "delta_truncate": (
        target("TRANSFORM t FROM orders GROUP BY o_orderpriority SELECT COUNT(*) AS n, SUM(o_totalprice) AS total", emptied=True),
        f"SELECT o_orderpriority, count(*) AS n, CAST(sum({CENTS}) AS DOUBLE) AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderpriority",
    ),
    "delta_chain": (
        target("TRANSFORM a FROM orders GROUP BY o_custkey, o_orderstatus SELECT COUNT(*) AS n, SUM(o_totalprice) AS total", "TRANSFORM b FROM a SELECT n AS n, total AS total WHERE total > 100000", "TRANSFORM c FROM b GROUP BY o_orderstatus SELECT COUNT(*) AS groups, SUM(n) AS n, SUM(total) AS total"),
        f"{ORDERS_AFTER}, a AS (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(price) AS total FROM o GROUP BY ALL HAVING sum(price) > 100000) SELECT o_orderstatus, count(*) AS groups, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(total) AS DOUBLE) AS total FROM a GROUP BY o_orderstatus",
    ),
}


def self_check_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of a chain after changes: nothing is missing and nothing is extra."""
    e = maintained(spark, sf_dir, "TRANSFORM a FROM orders GROUP BY o_custkey SELECT COUNT(*) AS n, SUM(o_totalprice) AS total", "TRANSFORM b FROM a SELECT total * 2 AS twice")
    rows = [(x["target"], x["ok"], x["missing"], x["extra"]) for x in map(e.self_check, ("a", "b"))]
    return spark.createDataFrame(rows, "target string, ok boolean, missing bigint, extra bigint")


def quarantine_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a division by zero holds, of the rows that a batch brings."""
    e = Engine(spark, workspace(spark), fuse=1_000_000_000)
    customers = table(spark, sf_dir, "customer")
    e.source("customer", customers.filter("c_custkey % 3 <> 0 AND c_nationkey <> 3"), ["c_custkey"])
    e.apply("TRANSFORM t FROM customer SELECT c_acctbal / (c_nationkey - 3.0) AS ratio")
    e.build()
    e.process({"customer": inserts(customers.filter("c_custkey % 3 = 0"))})
    return e.quarantined("t").select("transform", F.get_json_object("key", "$.c_custkey").cast("bigint").alias("c_custkey"), "field", "state")


REFUSED = (
    ("TRANSFORM t FROM orders SELECT o_custkey / 2 AS x", "IntegerDivision"),
    ("TRANSFORM t FROM orders SELECT o_custkey / 0.0 AS x", "ConstantDivisorZero"),
    ("TRANSFORM t FROM orders SELECT o_orderstatus < 'P' AS x", "TextOrderingComparison"),
    ("TRANSFORM t FROM orders SELECT o_custkey = 'a' AS x", "ComparisonTypeMismatch"),
    ("TRANSFORM t FROM orders SELECT NOW() AS x", "NonImmutableConstruct"),
    ("TRANSFORM t FROM orders SELECT UPPER(o_orderstatus) AS x", "UnsupportedFunction"),
    ("TRANSFORM t FROM orders SELECT o_orderstatus LIKE 'a' AS x", "UnsupportedOperator"),
    ("TRANSFORM t FROM orders SELECT o_orderstatus AS x ORDER BY x", "UnexpectedToken"),
    ("TRANSFORM t FROM orders SELECT SUM(o_custkey) AS x", "UngroupedColumnReference"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT COUNT(DISTINCT o_orderkey) AS x", "UnsupportedAggregateModifier"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT STRING_AGG(o_orderstatus, ',') AS x", "DeferredAggregate"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT MAX(o_totalprice + 1) AS x", "ExtremeOfExpression"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT MAX(o_orderstatus) AS x", "UnsupportedExtremeArgument"),
    ("TRANSFORM t FROM orders GROUP BY o_custkey SELECT MIN(o_totalprice) AS x WHERE o_orderstatus = 'F'", "FilteredExtreme"),
    ("TRANSFORM t FROM orders SELECT o_custkey AS x WHERE o_custkey + 1 > 2", "PredicateNotTotal"),
    ("TRANSFORM t FROM orders RIGHT JOIN customer ON orders.o_custkey = customer.c_custkey SELECT customer.c_name AS x", "UnsupportedKeySpace"),
    ("TRANSFORM t FROM orders JOIN orders ON orders.o_custkey = orders.o_orderkey SELECT orders.o_custkey AS x", "JoinSelf"),
    ("TRANSFORM t FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey SELECT orders.o_orderstatus AS x", "OneToOneJoinKeyNotUnique"),
    ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = customer.c_nationkey GROUP BY customer.c_name SELECT COUNT(*) AS x", "JoinKeyTypeMismatch"),
    ("TRANSFORM t FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_name SELECT SUM(orders.o_totalprice * customer.c_acctbal) AS x", "JoinMixedSideArgument"),
    ("TRANSFORM t FROM orders SELECT a + 1 AS b, b + 1 AS a", "Cycle"),
    ("TRANSFORM t FROM orders SELECT o_custkey + 1 AS o_orderstatus, o_orderstatus AS x", "AmbiguousColumnReference"),
    ("TRANSFORM t FROM orders SELECT CAST(o_orderkey AS int) AS x", "UnsupportedCast"),
    ("TRANSFORM t FROM orders SELECT o_orderkey::text AS x", "UnsupportedCastOperator"),
    ("TRANSFORM t FROM orders SELECT DATE '2024-1-5' AS x", "InvalidTypedLiteral"),
    ("TRANSFORM t FROM orders SELECT o_orderdate - o_orderdate AS x", "TemporalOperand"),
    ("TRANSFORM t FROM orders SELECT DATE_TRUNC('days', o_orderdate) AS x", "TemporalLiteral"),
    ("TRANSFORM t FROM events SELECT value % 2 AS x", "FloatModulo"),
    ("TRANSFORM t FROM events SELECT value = user_id AS x", "MixedFloatExactComparison"),
    ("TRANSFORM t FROM events GROUP BY value SELECT COUNT(*) AS x", "UnsupportedGroupByKeyType"),
    ("TRANSFORM t FROM events SELECT ROUND(value) AS x", "NumericFunctionArgument"),
)


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that are refused, each with the error's name."""
    s = Session()
    for name in ("orders", "customer", "events"):
        s.source(name, table(spark, sf_dir, name), KEYS[name])
    rows = []
    for text, _ in REFUSED:
        try:
            s.check(text)
            rows.append((text, "none"))
        except EngineError as e:
            rows.append((text, e.name))
    return spark.createDataFrame(rows, "statement string, error string")


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements are, without applying them."""
    texts = ("TRANSFORM t FROM s SELECT a AS b", "ALTER TRANSFORM t DROP b", "PAUSE TRANSFORM t.b", "RESUME TRANSFORM t", "DROP TRANSFORM t")
    return spark.createDataFrame([(t, statement_kind(t)) for t in texts], "statement string, kind string")


def _values(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in r) + ')' for r in rows)}) v({columns})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: plain(name) for name in PLAIN} | {name: f for name, (f, _) in DELTA.items()}
    return out | {f.__name__: f for f in (self_check_clean, quarantine_division, refusals, statement_kinds)} | maintenance_queries.queries()


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in PLAIN.items()} | {name: sql for name, (_, sql) in DELTA.items()}
    out["self_check_clean"] = "SELECT * FROM (VALUES ('a', TRUE, 0::BIGINT, 0::BIGINT), ('b', TRUE, 0, 0)) v(target, ok, missing, extra)"
    out["quarantine_division"] = "SELECT 't' AS transform, c_custkey, 'ratio' AS field, '22012' AS state FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey = 3"
    out["refusals"] = _values(REFUSED, "statement, error")
    kinds = (("TRANSFORM t FROM s SELECT a AS b", "transform"), ("ALTER TRANSFORM t DROP b", "alter"), ("PAUSE TRANSFORM t.b", "pause"), ("RESUME TRANSFORM t", "resume"), ("DROP TRANSFORM t", "drop"))
    return out | {"statement_kinds": _values(kinds, "statement, kind")} | maintenance_queries.oracle_sql(_values)
