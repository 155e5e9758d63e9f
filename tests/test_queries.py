"""Every registered query of the engine against its SQL in DuckDB, and what the entry module promises."""

import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from deltaloom import queries as Q
from verify_oracle import canonical

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = canonical(Q.queries()[name](spark, SF).toPandas()), canonical(duck.execute(Q.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_custkey", "order_count", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_operators():
    for p in [*(ROOT / "deltaloom").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
