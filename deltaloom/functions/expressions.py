"""Typed expressions as Spark columns.

Every operand is cast to the type that the checker decided, so Spark's own coercion never chooses one.
In ``guard`` mode nothing raises: a value that cannot be computed is NULL, and a second column
holds the SQLSTATE (22003 out of range, 22012 division by zero, 22008 date out of range). An expression in
which nothing can fail has no such column, and costs the same in both modes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaloom.plans import types as S
from deltaloom.plans.nodes import Agg, Between, Binary, Bool, Call, Case, Cast, Col, Expr, Extract, In, IsNull, Neg, Not, Null, Number, Text, Typed
from deltaloom.plans.types import DOUBLE, SqlType
from deltaloom.plans.typing import Scope, infer, literal_digits, scale_of

RANGE, ZERO, DATE_RANGE = "22003", "22012", "22008"
#: Days since 1970 of the first and last date that both sides know.
FIRST_DAY, LAST_DAY = -2_440_588, 2_145_042_541


@dataclass
class Value:
    col: Column
    err: Column | None = None  # SQLSTATE or NULL; None: cannot fail


class Compiler:
    """``column`` gives the Spark column of a (table, name)."""

    def __init__(self, scope: Scope, column: Callable[[str | None, str], Column], guard: bool = False):
        self.scope, self.column, self.guard = scope, column, guard

    def type(self, e: Expr) -> SqlType:
        return infer(e, self.scope)

    def value(self, e: Expr, to: SqlType | None = None) -> Value:
        """``e`` as a column; ``to`` is the type that its place wants."""
        v = self._value(e)
        t = self.type(e)
        if to is None or to == t:
            return v
        return Value(self.cast(v.col, t, to), v.err)

    def cast(self, col: Column, t: SqlType, to: SqlType) -> Column:
        if to.name == "numeric":
            return col.cast(f"decimal({to.precision},{to.scale})")
        return col if t.name == to.name else col.cast(S.to_spark(to))

    def _value(self, e: Expr) -> Value:
        if isinstance(e, Col):
            return Value(self.column(e.table, e.name))
        if isinstance(e, Number):
            t = S.number_type(e.text)
            return Value(F.lit(e.text).cast(f"decimal({t.precision},{t.scale})" if t.name == "numeric" else S.to_spark(t)))
        if isinstance(e, (Text, Bool)):
            return Value(F.lit(e.value))
        if isinstance(e, Null):
            return Value(F.lit(None))
        if isinstance(e, Typed):
            return Value(self.literal(e))
        if isinstance(e, IsNull):
            v = self.value(e.x)
            return Value(v.col.isNotNull() if e.negated else v.col.isNull(), v.err)
        if isinstance(e, Not):
            v = self.value(e.x, S.BOOLEAN)
            return Value(~v.col, v.err)
        if isinstance(e, Binary):
            return self.binary(e)
        if isinstance(e, Neg):
            v = self.value(e.x)
            zero = F.lit(0).cast(S.to_spark(self.type(e))) if self.type(e).name in S.INTEGERS else None
            return Value(-v.col, v.err) if zero is None else self.strict([v], lambda x: F.try_subtract(zero, x), lambda x: -x, RANGE)
        if isinstance(e, In):
            parts = [self.compare("<>" if e.negated else "=", e.x, i) for i in e.items]
            joined = reduce((lambda a, b: a & b) if e.negated else (lambda a, b: a | b), [p.col for p in parts])
            return Value(joined, first(p.err for p in parts))
        if isinstance(e, Between):
            low, high = self.compare(">=", e.x, e.low), self.compare("<=", e.x, e.high)
            inside = low.col & high.col
            return Value(~inside if e.negated else inside, first([low.err, high.err]))
        if isinstance(e, Case):
            return self.case(e)
        if isinstance(e, Cast):
            v = self.value(e.x)
            return Value(v.col.cast(S.to_spark(self.type(e)) if self.type(e).name != "numeric" or self.type(e.x).name == "unknown" else f"decimal({self.type(e).precision},{self.type(e).scale})"), v.err)
        if isinstance(e, Extract):
            v = self.value(e.x)
            return Value(extract(e.field, v.col, self.type(e.x).name).cast(f"decimal(38,{self.type(e).scale})"), v.err)
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Agg):
            raise TypeError("aggregates are compiled by the aggregate operator")
        raise TypeError(e)

    def literal(self, e: Typed) -> Column:
        value = S.literal_value(e.type, e.value)
        if e.type in ("date", "timestamp"):
            return F.lit(e.value).cast("date" if e.type == "date" else "timestamp_ntz")
        if e.type == "time":
            return F.lit(e.value).cast("time(6)")
        return F.lit(value).cast({"real": "float", "double precision": "double", "oid": "bigint", "bytea": "binary"}.get(e.type, "string"))

    def strict(self, args: list[Value], safe: Callable[..., Column], raising: Callable[..., Column], state: str) -> Value:
        """A function that fails where its ``safe`` form is NULL for arguments that are not."""
        cols, errs = [a.col for a in args], [a.err for a in args]
        if not self.guard:
            return Value(raising(*cols))
        out = safe(*cols)
        some = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        return Value(out, first([*errs, F.when(some & out.isNull(), F.lit(state))]))

    # operators

    def compare(self, op: str, x: Expr, y: Expr) -> Value:
        a, b = self.type(x), self.type(y)
        to: tuple[SqlType | None, SqlType | None] = (None, None)
        if "unknown" in (a.name, b.name):
            known = b if a.name == "unknown" else a
            to = (known, known) if known.name != "unknown" else (S.TEXT, S.TEXT)
        elif a.name in S.EXACT and b.name in S.EXACT and a.name != b.name or {a.name, b.name} & {*S.FLOATS} and a.name != b.name:
            shared = DOUBLE if {a.name, b.name} & {*S.FLOATS} else S.common([a, b], "ComparisonTypeMismatch", op)
            to = (shared, shared)
        left, right = self.value(x, to[0]), self.value(y, to[1])
        p, q = left.col, right.col
        if "bpchar" in (a.name, b.name):
            p, q = F.rtrim(p), F.rtrim(q)
        made = {"=": lambda: p == q, "<>": lambda: p != q, "<": lambda: p < q, "<=": lambda: p <= q, ">": lambda: p > q, ">=": lambda: p >= q, "IS NOT DISTINCT FROM": lambda: p.eqNullSafe(q), "IS DISTINCT FROM": lambda: ~p.eqNullSafe(q)}[op]
        return Value(made(), first([left.err, right.err]))

    def binary(self, e: Binary) -> Value:
        op = e.op
        if op in ("AND", "OR"):
            a, b = self.value(e.a, S.BOOLEAN), self.value(e.b, S.BOOLEAN)
            return Value(a.col & b.col if op == "AND" else a.col | b.col, first([a.err, b.err]))
        if op in ("=", "<>", "<", "<=", ">", ">=") or op.endswith("DISTINCT FROM"):
            return self.compare(op, e.a, e.b)
        if op == "AT TIME ZONE":
            v = self.value(e.a)
            return Value(v.col.cast("timestamp_ntz"), v.err)
        a, b, out = self.type(e.a), self.type(e.b), self.type(e)
        if "date" in (a.name, b.name):
            return self.dates(op, e, a, b)
        if out.name in S.FLOATS:
            return self.floats(op, self.value(e.a, out), self.value(e.b, out))
        if out.name in S.INTEGERS:
            args = [self.value(e.a, out), self.value(e.b, out)]
        else:
            a, b = (a if a.name != "unknown" else b), (b if b.name != "unknown" else a)
            a, b = (S.numeric(*literal_digits(x, t)) for x, t in ((e.a, a), (e.b, b)))
            if op == "*" and wide(a, b):
                return self.wide_product(self.value(e.a, a), self.value(e.b, b), a, b)
            p, q = fitted(op, a, b)
            args = [self.value(e.a, p), self.value(e.b, q)]
        safe = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[op]
        plain = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": lambda x, y: x % y}[op]
        v = self.strict(args, safe, plain, ZERO if op in "/%" else RANGE)
        if op in "/%" and self.guard:
            v.err = first([args[0].err, args[1].err, F.when(args[0].col.isNotNull() & (args[1].col == 0), F.lit(ZERO)).when(args[0].col.isNotNull() & args[1].col.isNotNull() & v.col.isNull(), F.lit(RANGE))])
        return Value(v.col.cast(f"decimal({out.precision},{out.scale})") if out.name == "numeric" else v.col, v.err)

    def wide_product(self, a: Value, b: Value, p: SqlType, q: SqlType) -> Value:
        """A product of which Spark would round digits away: exact under whichever split of the whole digits holds both operands."""
        (_, s), (_, r) = S.digits(p), S.digits(q)
        room = 37 - s - r
        tries = [F.try_multiply(a.col.try_cast(f"decimal({x + s},{s})"), b.col.try_cast(f"decimal({room - x + r},{r})")) for x in sorted({max(1, room * k // 6) for k in range(1, 6)})]
        out = F.coalesce(*tries)
        failed = a.col.isNotNull() & b.col.isNotNull() & out.isNull()
        if self.guard:
            return Value(out, first([a.err, b.err, F.when(failed, F.lit(RANGE))]))
        return Value(F.when(failed, F.raise_error(F.lit(RANGE)).cast(f"decimal(38,{s + r})")).otherwise(out))

    def floats(self, op: str, a: Value, b: Value) -> Value:
        """Float arithmetic; a result beyond the range, or a product or quotient that vanishes, fails."""
        x, y = a.col, b.col
        if op == "/":
            raw = F.try_divide(x, y)
        else:
            raw = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
        finite = ~(F.isnan(x) | F.isnan(y) | infinite(x) | infinite(y))
        failed = finite & infinite(raw)
        if op == "*":
            failed = failed | finite & (raw == 0) & (x != 0) & (y != 0)
        if op == "/":
            failed = failed | finite & (raw == 0) & (x != 0)
        state = F.when(failed, F.lit(RANGE))
        if op == "/":
            state = F.when(x.isNotNull() & (y == 0), F.lit(ZERO)).otherwise(state)
        if self.guard:
            return Value(F.when(state.isNull(), raw), first([a.err, b.err, state]))
        return Value(F.when(state.isNotNull(), F.raise_error(state).cast("double")).otherwise(raw))

    def dates(self, op: str, e: Binary, a: SqlType, b: SqlType) -> Value:
        x, y = self.value(e.a), self.value(e.b)
        if a.name == b.name:
            return Value(F.datediff(x.col, y.col), first([x.err, y.err]))
        day, n = (x, y) if a.name == "date" else (y, x)
        moved = F.unix_date(day.col).cast("bigint") + (n.col.cast("bigint") if op == "+" else -n.col.cast("bigint"))
        ok = moved.between(FIRST_DAY, LAST_DAY)
        state = F.when(~ok, F.lit(DATE_RANGE))
        out = F.date_add(day.col, F.when(ok, n.col.cast("int") if op == "+" else -n.col.cast("int")))
        if self.guard:
            return Value(out, first([x.err, y.err, state]))
        return Value(F.when(state.isNotNull(), F.raise_error(state).cast("date")).otherwise(out))

    def case(self, e: Case) -> Value:
        to = self.type(e)
        to = S.TEXT if to.name == "unknown" else to
        parts = [(self.value(c, S.BOOLEAN), self.value(v, to)) for c, v in e.whens]
        last = self.value(e.otherwise, to) if e.otherwise else Value(F.lit(None).cast(S.to_spark(to)))
        col, err = last.col, last.err
        for c, v in reversed(parts):
            col = F.when(c.col, v.col).otherwise(col)
            if v.err is not None or err is not None or c.err is not None:
                none = F.lit(None).cast("string")
                err = F.when(c.col, none if v.err is None else v.err).otherwise(none if err is None else err)
                err = err if c.err is None else F.coalesce(c.err, err)
        return Value(col, err)

    def call(self, e: Call) -> Value:
        name, out = e.name, self.type(e)
        if name == "COALESCE":
            to = S.TEXT if out.name == "unknown" else out
            parts = [self.value(x, to) for x in e.args]
            err = None
            for p in reversed(parts):  # an argument is looked at only where all before it are NULL
                if err is not None or p.err is not None:
                    none = F.lit(None).cast("string")
                    rest = F.when(p.col.isNull(), none if err is None else err)
                    err = rest if p.err is None else F.coalesce(p.err, rest)
            return Value(F.coalesce(*[p.col for p in parts]), err)
        if name == "NULLIF":
            same, a = self.compare("=", e.args[0], e.args[1]), self.value(e.args[0], S.TEXT if self.type(e.args[0]).name == "unknown" else None)
            return Value(F.when(same.col, F.lit(None)).otherwise(a.col), first([a.err, same.err]))
        if name == "DATE_TRUNC":
            v = self.value(e.args[1])
            return Value(date_trunc(e.args[0].value, v.col), v.err)
        args = [self.value(x) for x in e.args]
        x, errs = args[0].col, [a.err for a in args]
        if name == "STRPOS":
            return Value(F.call_function("locate", args[1].col, x), first(errs))
        if name in ("OCTET_LENGTH", "CHAR_LENGTH"):
            padded = name == "CHAR_LENGTH" and self.type(e.args[0]).name == "bpchar"
            return Value((F.octet_length if name == "OCTET_LENGTH" else F.char_length)(F.rtrim(x) if padded else x), errs[0])
        if name == "REGEXP_COUNT":
            return Value(F.regexp_count(x, F.lit(e.args[1].value)), errs[0])
        if name == "ABS":
            t = self.type(e.args[0])
            if t.name not in S.INTEGERS:
                return Value(F.abs(x), errs[0])
            zero = F.lit(0).cast(S.to_spark(t))
            return self.strict([args[0]], lambda v: F.when(v < 0, F.try_subtract(zero, v)).otherwise(v), F.abs, RANGE)
        return Value(self.rounded(name, e, x, out), errs[0])

    def rounded(self, name: str, e: Call, x: Column, out: SqlType) -> Column:
        if out.name == "double precision":
            whole = {"CEIL": F.ceil, "FLOOR": F.floor}.get(name, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)))
            return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(whole(x).cast("double"))
        n = scale_of(e.args[1]) if len(e.args) > 1 else 0
        scale = self.type(e.args[0]).scale
        if n >= scale:
            made = x
        elif name == "ROUND":
            made = F.round(x, n)
        elif name == "TRUNC":
            made = F.when(x < 0, F.ceil(x, F.lit(n))).otherwise(F.floor(x, F.lit(n)))
        else:
            made = (F.ceil if name == "CEIL" else F.floor)(x)
        return made.cast(f"decimal(38,{out.scale})")


def first(errs) -> Column | None:
    """The first error that is set."""
    found = [e for e in errs if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def wide(a: SqlType, b: SqlType) -> bool:
    """Whether Spark rounds a product of these types: it keeps six digits after the point at most where 38 are not enough."""
    (p, s), (q, r) = S.digits(a), S.digits(b)
    return p + q + 1 > 38 and 6 < s + r < 36


def fitted(op: str, a: SqlType, b: SqlType) -> tuple[SqlType, SqlType]:
    """Operand types under which Spark's result keeps every digit after the point, where 38 digits allow it."""
    (p, s), (q, r) = S.digits(a), S.digits(b)
    if op in "+-":
        most = 37 - max(s, r)
        return S.numeric(min(p, most + s), s), S.numeric(min(q, most + r), r)
    return S.numeric(p, s), S.numeric(q, r)


def date_trunc(unit: str, x: Column) -> Column:
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if span is None:
        return F.date_trunc({"microseconds": "microsecond", "milliseconds": "millisecond"}.get(unit, unit), x).cast("timestamp_ntz")
    year = F.year(x)
    start = F.floor(year / span) * span if unit == "decade" else F.ceil(year / span) * span - (span - 1)
    return F.make_timestamp_ntz(start.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def extract(field: str, x: Column, kind: str) -> Column:
    micros = F.unix_micros(x.cast("timestamp")) if kind == "timestamp" else None
    seconds = F.pmod(micros, F.lit(60_000_000)) if micros is not None else None
    scaled = lambda c, by, scale: (c.cast("decimal(25,0)") / F.lit(by).cast("decimal(10,0)")).cast(f"decimal(38,{scale})")
    made = {
        "year": lambda: F.year(x),
        "quarter": lambda: F.quarter(x),
        "month": lambda: F.month(x),
        "week": lambda: F.weekofyear(x),
        "day": lambda: F.dayofmonth(x),
        "dow": lambda: F.dayofweek(x) - 1,
        "isodow": lambda: F.weekday(x) + 1,
        "doy": lambda: F.dayofyear(x),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), x),
        "decade": lambda: F.floor(F.year(x) / 10),
        "century": lambda: F.ceil(F.year(x) / 100),
        "millennium": lambda: F.ceil(F.year(x) / 1000),
        "epoch": lambda: F.unix_date(x).cast("bigint") * 86400 if micros is None else scaled(micros, 1_000_000, 6),
        "hour": lambda: F.hour(x),
        "minute": lambda: F.minute(x),
        "second": lambda: scaled(seconds, 1_000_000, 6),
        "milliseconds": lambda: scaled(seconds, 1000, 3),
        "microseconds": lambda: seconds,
    }
    return made[field]()



