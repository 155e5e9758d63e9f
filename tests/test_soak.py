"""A longer run: two sources, a chain, random batches through the log. DuckDB runs each definition's own SELECT over the sources as they are."""

import random
from decimal import Decimal

import duckdb
import pytest

from deltaloom.sources.changelog import ChangeLog, snapshot_diff
from deltaloom.streaming.engine import Engine
from verify_oracle import canonical

ACCOUNTS, ORDERS = "id bigint, region int, name string, balance decimal(14,2), active boolean", "id bigint, account_id bigint, amount decimal(12,2), status string"
DEFINITIONS = {
    "holders": "TRANSFORM holders FROM accounts SELECT name AS holder, balance * 2 AS twice, region AS region WHERE active",
    "regions": "TRANSFORM regions FROM accounts GROUP BY region SELECT COUNT(*) AS n, SUM(balance) AS total",
    "spent": "TRANSFORM spent FROM orders GROUP BY account_id SELECT COUNT(*) AS n, SUM(amount) AS total, MIN(amount) AS least, MAX(amount) AS most",
    "by_region": "TRANSFORM by_region FROM orders JOIN accounts ON orders.account_id = accounts.id GROUP BY accounts.region SELECT SUM(orders.amount) AS total, COUNT(*) AS n",
    "wide": "TRANSFORM wide FROM orders LEFT JOIN accounts ON orders.account_id = accounts.id SELECT accounts.name AS holder, accounts.region AS region, orders.amount AS amount",
    "large": "TRANSFORM large FROM spent SELECT total AS total, n AS n WHERE total > 170",
    "sizes": "TRANSFORM sizes FROM large GROUP BY n SELECT COUNT(*) AS accounts, SUM(total) AS total",
}


def account(r, i):
    return (i, r.randint(1, 4), f"name {r.randint(0, 9)}", Decimal(r.randint(-5000, 90000)) / 100, r.random() < 0.7)


def order(r, i):
    return (i, r.randint(1, 14), Decimal(r.randint(1, 9900)) / 100, r.choice(["paid", "open"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_follow_their_sources(spark, tmp_path, seed):
    r = random.Random(seed)
    state = {"accounts": {i: account(r, i) for i in range(1, 11)}, "orders": {i: order(r, i) for i in range(1, 61)}}
    schema, make = {"accounts": ACCOUNTS, "orders": ORDERS}, {"accounts": account, "orders": order}
    frame = lambda n, rows: spark.createDataFrame(list(rows.values()), schema[n])
    e = Engine(spark, str(tmp_path / "e"), buckets=2, threads=6)
    for n, rows in state.items():
        e.source(n, frame(n, rows), ["id"])
    for text in DEFINITIONS.values():
        e.apply(text)
    log = ChangeLog(e)
    for _ in range(2):
        for _ in range(r.randint(1, 2)):  # commits of one batch
            changes = {}
            for n in r.sample(["accounts", "orders"], r.randint(1, 2)):
                now = dict(state[n])
                for i in r.sample(range(1, 15 if n == "accounts" else 75), 5 if n == "accounts" else 20):
                    if r.random() < 0.3:
                        now.pop(i, None)
                    else:
                        now[i] = make[n](r, i)
                changes[n] = snapshot_diff(frame(n, state[n]), frame(n, now), ["id"])
                state[n] = now
            log.append(changes)
        assert log.drain() == e.watermark_token()
    con = duckdb.connect()
    for n in state:
        con.register(n, frame(n, state[n]).toArrow())
    for name in DEFINITIONS:
        con.execute(f"CREATE VIEW {name} AS {e.target_select_sql(name)}")
        got, want = e.table(name).toPandas(), con.execute(f"SELECT * FROM {name}").fetchdf()
        plain = lambda df: canonical(df.apply(lambda c: c.map(lambda v: float(v) if isinstance(v, Decimal) else v)))
        assert plain(got).equals(plain(want)), name
