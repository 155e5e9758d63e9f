"""Values of expressions and aggregates at their edges."""

import datetime as dt
import math
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException

from deltaloom.errors import EngineError
from deltaloom.functions import exact
from deltaloom.session import Session
from deltaloom.sources.changelog import snapshot_diff
from deltaloom.streaming.engine import Engine

SCHEMA = "id int, s smallint, i int, l bigint, n decimal(12,2), r float, d double, t string, b boolean, day date, ts timestamp_ntz, tz timestamp, c string, e string, u string"
ROW = (1, 7, -7, 2**40, Decimal("-2.55"), 0.1, 1e30, "café x", True, dt.date(2024, 2, 25), dt.datetime(2024, 2, 25, 10, 11, 12, 345678), dt.datetime(2024, 12, 30, 1, 2, 3), "ab  ", "open", "0b6c0f3e-0000-0000-0000-000000000001")


@pytest.fixture(scope="module")
def one(spark):
    rows = spark.createDataFrame([ROW], SCHEMA)
    return Session().source("s", rows, ["id"], types={"c": "bpchar", "e": "enum", "u": "uuid"}, labels={"e": ("open", "paid")})


VALUES = {
    "s * s": 49,
    "i % 3": -1,
    "7 % i": 0,
    "i + s": 0,
    "l + i": 2**40 - 7,
    "n * n": Decimal("6.5025"),
    "n / 2": Decimal("-1.275"),
    "n + i": Decimal("-9.55"),
    "ROUND(n, 1)": Decimal("-2.6"),
    "ROUND(n)": Decimal("-3"),
    "ROUND(125, -1)": None,
    "ROUND(125.0, -1)": Decimal("130"),
    "TRUNC(n)": Decimal("-2"),
    "TRUNC(n, 1)": Decimal("-2.5"),
    "CEIL(n)": Decimal("-2"),
    "FLOOR(n)": Decimal("-3"),
    "CEIL(d)": 1e30,
    "FLOOR(d)": 1e30,
    "ABS(i)": 7,
    "-i": 7,
    "r > 0.1": True,
    "r = 0.1": False,
    "r > REAL '0.1'": False,
    "d > 1": True,
    "r + r": 0.2,
    "COALESCE(r, n)": 0.1,
    "STRPOS(t, 'x')": 6,
    "STRPOS(t, '')": 1,
    "CHAR_LENGTH(t)": 6,
    "OCTET_LENGTH(t)": 7,
    "REGEXP_COUNT(t, '[a-c]')": 2,
    "c = 'ab'": True,
    "e = 'open'": True,
    "e IN ('paid', 'open')": True,
    "u = u": True,
    "b AND NULL": None,
    "NOT b OR NULL": None,
    "NULL AND FALSE": False,
    "i NOT IN (2, NULL)": None,
    "NULL IS NOT DISTINCT FROM NULL": True,
    "CASE WHEN NULL THEN 1 WHEN b THEN 2 END": 2,
    "NULLIF(i, -7)": None,
    "day + 4": dt.date(2024, 2, 29),
    "day - day": 0,
    "EXTRACT(dow FROM day)": Decimal(0),
    "EXTRACT(isodow FROM day)": Decimal(7),
    "EXTRACT(isoyear FROM ts)": Decimal(2024),
    "EXTRACT(century FROM day)": Decimal(21),
    "EXTRACT(millennium FROM day)": Decimal(3),
    "EXTRACT(decade FROM day)": Decimal(202),
    "EXTRACT(second FROM ts)": Decimal("12.345678"),
    "EXTRACT(milliseconds FROM ts)": Decimal("12345.678"),
    "EXTRACT(microseconds FROM ts)": Decimal(12345678),
    "EXTRACT(epoch FROM day)": Decimal(1708819200),
    "DATE_TRUNC('century', ts)": dt.datetime(2001, 1, 1),
    "DATE_TRUNC('decade', ts)": dt.datetime(2020, 1, 1),
    "DATE_TRUNC('week', ts)": dt.datetime(2024, 2, 19),
    "tz AT TIME ZONE 'UTC'": dt.datetime(2024, 12, 30, 1, 2, 3),
    "CAST(day AS timestamp)": dt.datetime(2024, 2, 25),
    "CAST(s AS numeric) / 2": Decimal("3.5"),
    "NULL": None,
}


@pytest.mark.parametrize("text", [v for v in VALUES if v != "ROUND(125, -1)"])
def test_value(one, text):
    got = one.transform(f"TRANSFORM x FROM s SELECT {text} AS v").first()["v"]
    want = VALUES[text]
    assert got == pytest.approx(want, rel=1e-6) if isinstance(want, float) else got == want and type(got) is type(want)


TYPES = {"s + s": "smallint", "i + l": "bigint", "i + n": "decimal(38,2)", "r + r": "float", "r + n": "double", "COALESCE(r, n)": "float", "COALESCE(s, i)": "int", "NULL": "string", "EXTRACT(year FROM day)": "decimal(38,0)", "day - day": "int", "2147483648": "bigint", "1.50": "decimal(38,2)"}


@pytest.mark.parametrize("text", TYPES)
def test_type(one, text):
    assert one.transform(f"TRANSFORM x FROM s SELECT {text} AS v").schema["v"].dataType.simpleString() == TYPES[text]


REFUSED = {
    "i / 2": "IntegerDivision", "n / 0": "ConstantDivisorZero", "n / -0.0": "ConstantDivisorZero", "d % 2": "FloatModulo", "i + t": "TypeMismatch", "NULL + NULL": "UntypedNull", "ABS(NULL)": "UntypedNull",
    "d = n": "MixedFloatExactComparison", "day = ts": "MixedTemporalComparison", "t < 'a'": "TextOrderingComparison", "i = t": "ComparisonTypeMismatch", "e = 'shut'": "EnumLiteralNotALabel", "e <> 'open'": "ComparisonTypeMismatch",
    "NULLIF(i, n)": "NullIfFirstArgumentCast", "CASE WHEN i THEN 1 END": "CaseConditionNotBoolean", "CASE WHEN b THEN 1 ELSE 'a' END": "CaseResultTypeMismatch", "ts - ts": "TemporalOperand", "day + l": "TemporalOperand",
    "DATE_TRUNC('day', day)": "TemporalOperand", "EXTRACT(hour FROM day)": "TemporalLiteral", "CAST(l AS int)": "UnsupportedCast", "CAST(tz AS timestamp)": "TemporalOperand", "CEIL(i)": "NumericFunctionArgument",
    "ROUND(d)": "NumericFunctionArgument", "ROUND(n, i)": "ScaleNotIntegerLiteral", "CHAR_LENGTH(i)": "FunctionArgTypeMismatch", "REGEXP_COUNT(t, t)": "NonLiteralRegexPattern", "REGEXP_COUNT(t, '[[:alpha:]]')": "InvalidRegexPattern",
    "nowhere": "UnresolvedColumn", "other.i": "QualifiedColumnNotFromSource", "r IN (0.1)": "InListCommonType", "NOT i": "TypeMismatch", "ROUND(125, -1)": "NumericFunctionArgument", "REAL '1.50'": "InvalidTypedLiteral",
}


@pytest.mark.parametrize("text", REFUSED)
def test_refused(one, text):
    with pytest.raises(EngineError) as e:
        one.check(f"TRANSFORM x FROM s SELECT {text} AS v")
    assert e.value.name == REFUSED[text]


@pytest.mark.parametrize("text", ["i + 1 > 2", "i / 2.0 > 1", "i % i = 0", "-i > 0", "ABS(i) > 0", "CEIL(n) > 0", "REGEXP_COUNT(t, 'a') > 1", "DATE_TRUNC('month', ts) = ts", "day + 1 > day", "CAST(day AS timestamp) = ts", "t = c", "COALESCE(r, n) > 1"])
def test_predicates_have_to_be_total(one, text):
    with pytest.raises(EngineError, match="PredicateNotTotal"):
        one.check(f"TRANSFORM x FROM s SELECT i AS v WHERE {text}")


@pytest.mark.parametrize("text", ["i % 2 = 1", "i IN (1, 2) OR b", "n BETWEEN 1 AND 2", "EXTRACT(year FROM day) = 2024", "CHAR_LENGTH(t) > 1", "STRPOS(t, 'a') = 0", "ABS(n) > 1", "-n > 0", "DATE_TRUNC('week', ts) = ts", "NULLIF(i, 1) IS NULL", "d > 0.5"])
def test_total_predicates_are_admitted(one, text):
    one.check(f"TRANSFORM x FROM s SELECT i AS v WHERE {text}")


def test_refusals_of_shape(one):
    for text, name in {
        "TRANSFORM x FROM s SELECT i AS v, l AS v": "DuplicateFieldName",
        "TRANSFORM x FROM s SELECT i AS __v": "ReservedFieldName",
        "TRANSFORM x FROM s SELECT i AS id": "FieldNamedAfterPrimaryKey",
        "TRANSFORM x FROM s KEY (i) SELECT i AS v": "KeyNotBacked",
        "TRANSFORM x FROM s KEY (n) SELECT i AS v": "UnsupportedPrimaryKeyType",
        "TRANSFORM x FROM s SELECT i AS v WHERE i": "PredicateNotBoolean",
        "TRANSFORM x FROM s SELECT i AS v WHERE nowhere": "PredicateColumnNotFound",
        "TRANSFORM x FROM s SELECT i AS v WHERE COUNT(*) > 1": "AggregateInPredicate",
        "TRANSFORM x FROM s GROUP BY d SELECT COUNT(*) AS n": "UnsupportedGroupByKeyType",
        "TRANSFORM x FROM s GROUP BY nowhere SELECT COUNT(*) AS n": "UnresolvedGroupByColumn",
        "TRANSFORM x FROM s GROUP BY i, s.i SELECT COUNT(*) AS n": "GroupByKeysShareTargetColumn",
        "TRANSFORM x FROM s GROUP BY i SELECT l AS n": "UngroupedColumnReference",
        "TRANSFORM x FROM s GROUP BY i SELECT i + 1 AS i": "GroupingColumnFieldMustBePassthrough",
        "TRANSFORM x FROM s GROUP BY i SELECT SUM(COUNT(*)) AS n": "AggregateOfAggregateField",
        "TRANSFORM x FROM s GROUP BY i SELECT SUM(t) AS n": "UnsupportedAggregateArgument",
        "TRANSFORM x FROM s GROUP BY i WITHOUT SOURCE INDEX SELECT MAX(l) AS n": "ExtremesWithoutSourceIndex",
    }.items():
        with pytest.raises(EngineError) as e:
            one.check(text)
        assert e.value.name == name, text
    assert [n for n in one.check("TRANSFORM x FROM s GROUP BY i SELECT SUM(l) AS l, COUNT(l) AS n").types] == ["i", "l", "n"]


def test_fields_may_shadow_columns_as_in_sql(one):
    got = one.transform("TRANSFORM x FROM s GROUP BY i SELECT SUM(l) AS l, COUNT(l) AS n, (i + 1) AS next, SUM(next) AS sum").first()
    assert (got["l"], got["n"], got["sum"]) == (2**40, 1, -6)


def test_overflow_raises_in_a_build(spark):
    s = Session().source("s", spark.createDataFrame([(1, 2**31 - 1, 1e308)], "id int, i int, d double"), ["id"])
    for text in ("i + 1", "d * 10"):
        with pytest.raises(PySparkException):
            s.transform(f"TRANSFORM x FROM s SELECT {text} AS v").collect()
    assert s.transform("TRANSFORM x FROM s SELECT CASE WHEN i < 0 THEN i + 1 ELSE 0 END AS v").first()["v"] == 0


def test_float_sums_are_exact_and_retractable(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    groups = {1: [1e20, 1.0, -1e20], 2: [0.1] * 10, 3: [5e-324, 1e308, -1e308], 4: [inf, 1.0], 5: [inf, -inf], 6: [nan, 1.0], 7: [], 8: [1.7976931348623157e308, -5e-324, 2.2250738585072014e-308, 1 / 3]}
    rows = [(i, g, x) for i, (g, x) in enumerate((g, x) for g, xs in groups.items() for x in (xs or [None]))]
    schema = "id int, g int, x double"
    got = {r["g"]: r for r in Session().source("s", spark.createDataFrame(rows, schema), ["id"]).transform("TRANSFORM t FROM s GROUP BY g SELECT SUM(x) AS s, AVG(x) AS m").collect()}
    for g, xs in groups.items():
        want = math.fsum(xs) if xs and not any(math.isinf(x) or math.isnan(x) for x in xs) else {4: inf, 5: nan, 6: nan, 7: None}[g]
        assert got[g]["s"] == want or want is not None and math.isnan(want) and math.isnan(got[g]["s"])
    assert got[2]["m"] == float(sum(Fraction(0.1) for _ in range(10)) / 10)
    e = Engine(spark, str(tmp_path), buckets=2)
    base = spark.createDataFrame(rows, schema)
    e.source("s", base, ["id"])
    e.apply("TRANSFORM t FROM s GROUP BY g SELECT SUM(x) AS s")
    e.build()
    left = base.filter("NOT (isnan(x) OR abs(x) >= 1e20)")
    e.process({"s": snapshot_diff(base, left, ["id"])})
    assert {r["g"]: r["s"] for r in e.table("t").collect()} == {1: 1.0, 2: 1.0, 3: 5e-324, 4: 1.0, 6: 1.0, 8: math.fsum([-5e-324, 2.2250738585072014e-308, 1 / 3])}


def test_real_sums_round_once():
    assert exact.round_once({0: 2**24, 30: 1}, real=True) == 2.0**24
    assert exact.round_once({0: 2**24 + 1, 30: 1}, real=True) == 2.0**24 + 2
    assert exact.round_once({}, None) == 0.0


def test_intervals(spark):
    rows = [(1, 1, (1, 2, 3_600_000_000)), (2, 1, (0, 40, 0)), (3, 2, None)]
    s = Session().source("s", spark.createDataFrame(rows, "id int, g int, x struct<months:int,days:int,micros:bigint>"), ["id"])
    got = {r["g"]: r for r in s.transform("TRANSFORM t FROM s GROUP BY g SELECT SUM(x) AS s, MIN(x) AS low, MAX(x) AS high, AVG(x) AS mean").collect()}
    assert tuple(got[1]["s"]) == (1, 42, 3_600_000_000) and tuple(got[1]["low"]) == (1, 2, 3_600_000_000) and tuple(got[1]["high"]) == (0, 40, 0)
    assert tuple(got[1]["mean"]) == (0, 36, 1_800_000_000)
    assert got[2]["s"] is None and got[2]["mean"] is None


def test_wide_decimals_keep_their_digits(spark):
    s = Session().source("s", spark.createDataFrame([(1, Decimal("123456789012.1234567890"), Decimal("2.0000000001"))], "id int, a decimal(38,10), b decimal(38,10)"), ["id"])
    got = s.transform("TRANSFORM t FROM s SELECT a * b AS p, a + b AS s").first()
    assert got["s"] == Decimal("123456789014.1234567891")
    assert got["p"] == Decimal("246913578036.59259247921234567890")


def test_partitioned_sources(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, p string, v int")
    s = Session().source("s", rows, ["id"], partitions=("p",))
    assert s.transform("TRANSFORM t FROM s GROUP BY p SELECT SUM(v) AS v").count() == 2
    with pytest.raises(EngineError, match="PartitionedSource"):
        s.check("TRANSFORM u FROM s GROUP BY v SELECT COUNT(*) AS n")
