"""Benchmark: full builds of the headline definitions, and maintenance batches against them. Prints one line of JSON.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads (default 8). ``queries`` holds seconds: builds are
the median of three runs after a warm-up; ``batch_*`` is one maintenance batch of that many changes. ``ratios`` holds a
batch's seconds over those of a full rebuild of the same engine, the figure that compares across engines.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom import queries as Q
from deltaloom.sources.changelog import inserts, updates
from deltaloom.streaming.engine import Engine

HEADLINE = ("one_to_one_where", "agg_count_sum_avg", "agg_orders_by_customer", "agg_min_max", "agg_float_sum", "join_inner_group_by", "join_left_group_by", "one_to_one_join_left", "star_join", "chain_distinct_count", "chain_having")
BATCHES = (1_000, 10_000, 100_000)
DEFINITIONS = (
    "TRANSFORM totals FROM orders GROUP BY o_custkey SELECT COUNT(*) AS n, SUM(o_totalprice) AS total",
    "TRANSFORM extremes FROM orders GROUP BY o_orderstatus, o_orderpriority SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high",
    "TRANSFORM by_segment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment SELECT SUM(orders.o_totalprice) AS total, COUNT(*) AS n",
    "TRANSFORM view FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey SELECT customer.c_name AS name, orders.o_totalprice * 2 AS twice",
)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def grown(orders: DataFrame, n: int, offset: int) -> DataFrame:
    """``n`` new orders: those there are, again and again under new keys."""
    have = orders.count()
    times = -(-n // max(1, have))
    wide = orders.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("o_orderkey", F.col("o_orderkey") + F.col("t") * 10_000_000 + offset)
    return wide.drop("t").limit(n)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{work}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, ratios = {}, {}
    every = Q.queries()
    for name in HEADLINE:
        consume(every[name](spark, sf_dir))
        took[name] = round(statistics.median(seconds(lambda n=name: consume(every[n](spark, sf_dir))) for _ in range(3)), 3)
    orders, customers = Q.table(spark, sf_dir, "orders"), Q.table(spark, sf_dir, "customer")
    e = Engine(spark, f"{work}/engine", buckets=int(cpus))
    e.source("orders", orders, ["o_orderkey"])
    e.source("customer", customers, ["c_custkey"])
    for d in DEFINITIONS:
        e.apply(d)
    e.build()
    took["rebuild_all"] = round(seconds(lambda: e.request_backfill("orders")), 3)
    e.process({"orders": inserts(grown(orders, 100, 1))})
    for n in BATCHES:
        rows = grown(orders, n, 5_000_000 + n)
        took[f"batch_{n}"] = round(seconds(lambda r=rows: e.process({"orders": inserts(r)})), 3)
        ratios[f"batch_{n}"] = round(took[f"batch_{n}"] / took["rebuild_all"], 3)
    top = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("o_orderkey"))
    took["batch_extreme_retract"] = round(seconds(lambda: e.process({"orders": updates(orders.join(top.select("o_orderkey"), "o_orderkey", "left_semi").select(*orders.columns), o_totalprice=F.lit(1))})), 3)
    took["batch_dimension"] = round(seconds(lambda: e.process({"customer": updates(customers.filter("c_custkey % 50 = 0"), c_mktsegment=F.lit("MOVED"))})), 3)
    alone = Engine(spark, f"{work}/alone", buckets=int(cpus))
    alone.source("orders", orders, ["o_orderkey"])
    alone.apply(DEFINITIONS[0])
    alone.build()
    alone.process({"orders": inserts(grown(orders, 100, 1))})
    many = grown(orders, 1_000_000, 7)
    many.repartition(int(cpus)).write.parquet(f"{work}/many")
    took["apply_1m_one_aggregate"] = round(seconds(lambda: alone.process({"orders": inserts(spark.read.parquet(f"{work}/many"))})), 3)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ratios": ratios, "rows_per_second": {f"batch_{n}": round(n / took[f"batch_{n}"]) for n in BATCHES} | {"apply_1m_one_aggregate": round(1_000_000 / took["apply_1m_one_aggregate"])}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
