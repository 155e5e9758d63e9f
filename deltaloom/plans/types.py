"""SQL types: what they are in Spark, what each may be used for, and how they combine."""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from deltaloom.errors import refuse


@dataclass(frozen=True)
class SqlType:
    """``name`` as PostgreSQL says it; ``precision`` and ``scale`` of a numeric say what Spark has to hold, and are no part of the type."""

    name: str
    precision: int = 38
    scale: int = 0

    def same(self, other: SqlType) -> bool:
        return self.name == other.name

    def __str__(self) -> str:
        return self.name


SMALLINT, INTEGER, BIGINT = SqlType("smallint", 5), SqlType("integer", 10), SqlType("bigint", 19)
REAL, DOUBLE, TEXT, BOOLEAN = SqlType("real"), SqlType("double precision"), SqlType("text"), SqlType("boolean")
DATE, TIMESTAMP, TIMESTAMPTZ, TIME = SqlType("date"), SqlType("timestamp"), SqlType("timestamptz"), SqlType("time")
INTERVAL, UNKNOWN = SqlType("interval"), SqlType("unknown")
INTERVAL_SPARK = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])

INTEGERS = ("smallint", "integer", "bigint")
EXACT = (*INTEGERS, "numeric")
FLOATS = ("real", "double precision")
TEMPORAL = ("date", "timestamp", "timestamptz", "time", "timetz")
#: Types held as canonical text in Spark. A source column of one is declared; Spark only sees a string.
AS_TEXT = ("text", "bpchar", "uuid", "timetz", "jsonb", "json", "inet", "cidr", "macaddr", "macaddr8", "bit", "varbit", "enum", "money", "xml", "tsvector", "tsquery")
#: Roles.
KEYS = (*INTEGERS, "oid", "uuid", "text", "bytea", "date", "time", "timetz", "timestamp", "timestamptz", "cidr", "macaddr", "macaddr8", "bit", "varbit", "enum")
GROUP_KEYS = (*EXACT, "oid", "boolean", "uuid", "text", "bpchar", "bytea", "date", "time", "timetz", "timestamp", "timestamptz", "inet", "cidr", "macaddr", "macaddr8", "varbit", "enum")
SUMMED = (*EXACT, *FLOATS, "interval")
EXTREMES = (*EXACT, *FLOATS, "date", "time", "timestamp", "timestamptz", "interval", "oid")


def numeric(precision: int, scale: int) -> SqlType:
    return SqlType("numeric", min(38, precision), scale)


def of_spark(kind: T.DataType, declared: str | None = None) -> SqlType:
    """The SQL type of a source column; ``declared`` names one that Spark holds as text (or oid, as a long)."""
    if declared is not None:
        if declared not in (*AS_TEXT, "oid"):
            raise refuse("TypeMismatch", f"{declared} cannot be declared")
        return SqlType(declared)
    if isinstance(kind, T.DecimalType):
        return numeric(kind.precision, kind.scale)
    found = {"smallint": SMALLINT, "int": INTEGER, "bigint": BIGINT, "float": REAL, "double": DOUBLE, "string": TEXT, "boolean": BOOLEAN, "date": DATE, "timestamp_ntz": TIMESTAMP, "timestamp": TIMESTAMPTZ, "binary": SqlType("bytea")}
    name = kind.simpleString()
    if name.startswith("time("):
        return TIME
    if kind == INTERVAL_SPARK or name == INTERVAL_SPARK.simpleString():
        return INTERVAL
    return found.get(name, SqlType("unsupported"))


def to_spark(t: SqlType) -> str:
    """The Spark type of a stored column: copies drop a numeric's precision but not its scale."""
    if t.name == "numeric":
        return f"decimal(38,{t.scale})"
    plain = {"smallint": "smallint", "integer": "int", "bigint": "bigint", "oid": "bigint", "real": "float", "double precision": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "time": "time(6)", "bytea": "binary"}
    return plain.get(t.name, INTERVAL_SPARK.simpleString() if t.name == "interval" else "string")


def wider(a: SqlType, b: SqlType) -> SqlType:
    return a if a.precision >= b.precision else b


def digits(t: SqlType) -> tuple[int, int]:
    """Precision and scale of an exact type."""
    return (t.precision, t.scale) if t.name == "numeric" else (t.precision, 0)


def common(types: list[SqlType], error: str, what: str) -> SqlType:
    """The type that COALESCE, CASE and IN give several values; ``unknown`` takes any."""
    known = [t for t in types if t.name != "unknown"]
    if not known:
        return UNKNOWN
    out = known[0]
    for t in known[1:]:
        if out.name in INTEGERS and t.name in INTEGERS:
            out = wider(out, t)
        elif out.name in EXACT and t.name in EXACT:
            (p, s), (q, r) = digits(out), digits(t)
            out = numeric(max(p - s, q - r) + max(s, r), max(s, r))
        elif out.name in FLOATS and t.name in (*EXACT, *FLOATS) or t.name in FLOATS and out.name in EXACT:
            out = DOUBLE if "double precision" in (out.name, t.name) else REAL
        elif {out.name, t.name} == {"text", "bpchar"}:
            out = SqlType("bpchar")
        elif out.name != t.name:
            raise refuse(error, f"{what}: {out} and {t}")
    return out


def number_type(text: str) -> SqlType:
    """The type of a number literal, by its value."""
    if "." in text:
        whole, _, part = text.lstrip("-").partition(".")
        return numeric(max(1, len(whole) + len(part)), len(part))
    n = int(text)
    return INTEGER if -(2**31) <= n < 2**31 else BIGINT if -(2**63) <= n < 2**63 else numeric(len(text.lstrip("-")), 0)


def float_text(x: float, shortest: str, limit: int) -> str:
    """How PostgreSQL prints a float, of the shortest digits that give it back."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    sign = "-" if shortest.startswith("-") else ""
    mantissa, _, exponent = shortest.lstrip("-").partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    e = int(exponent or 0) + len(whole) - 1
    d = (whole + part).lstrip("0")
    if not d:
        return sign + "0"
    if whole.strip("0") == "":
        e = int(exponent or 0) - 1 - (len(part) - len(part.lstrip("0")))
    d = d.rstrip("0")
    if -4 <= e < limit:
        return sign + (f"0.{'0' * (-e - 1)}{d}" if e < 0 else d.ljust(e + 1, "0") if len(d) <= e + 1 else f"{d[: e + 1]}.{d[e + 1 :]}")
    return sign + d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"


def _clock(text: str) -> bool:
    m = re.fullmatch(r"(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?", text)
    return bool(m) and int(m[1]) < 24 and int(m[2]) < 60 and int(m[3]) < 60 and not (m[4] or "1").endswith("0")


def _json(text: str) -> str:
    def sort(v):
        if isinstance(v, dict):
            return {k: sort(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
        return [sort(x) for x in v] if isinstance(v, list) else v

    return json.dumps(sort(json.loads(text)), ensure_ascii=False, separators=(", ", ": "))


def literal_value(kind: str, text: str) -> object:
    """The Python value of a typed literal, whose text has to be the canonical one of its type."""
    try:
        if kind == "date":
            ok, value = dt.date.fromisoformat(text).isoformat() == text, dt.date.fromisoformat(text)
        elif kind == "timestamp":
            day, _, clock = text.partition(" ")
            ok, value = dt.date.fromisoformat(day).isoformat() == day and _clock(clock), text
        elif kind == "time":
            ok, value = _clock(text), text
        elif kind == "timetz":
            ok, value = _clock(re.sub(r"[+-]\d\d(:\d\d)?$", "", text)) and text[-3:-2] in "+-:", text
        elif kind == "bytea":
            ok, value = re.fullmatch(r"\\x([0-9a-f]{2})*", text) is not None, bytes.fromhex(text[2:])
        elif kind == "oid":
            ok, value = str(int(text)) == text and 0 <= int(text) < 2**32, int(text)
        elif kind == "double precision":
            ok, value = float_text(float(text), repr(float(text)), 15) == text, float(text)
        elif kind == "real":
            import numpy as np

            value = float(np.float32(text))
            ok = float_text(value, np.format_float_scientific(np.float32(text)) if np.isfinite(value) else "", 6) == text
        elif kind in ("inet", "cidr"):
            net = ipaddress.ip_interface(text) if kind == "inet" else ipaddress.ip_network(text)
            ok, value = text in (str(net), str(net).removesuffix("/32").removesuffix("/128")) if kind == "inet" else str(net) == text, text
        elif kind in ("macaddr", "macaddr8"):
            ok, value = re.fullmatch(r"[0-9a-f]{2}(:[0-9a-f]{2}){%d}" % (5 if kind == "macaddr" else 7), text) is not None, text
        elif kind == "varbit":
            ok, value = re.fullmatch(r"[01]*", text) is not None, text
        else:
            ok, value = _json(text) == text, text
    except (ValueError, ArithmeticError):
        ok, value = False, None
    if not ok:
        raise refuse("InvalidTypedLiteral", f"{kind.upper()} '{text}' is not the canonical spelling")
    return value
