"""Partial aggregates: the state that COUNT, SUM, AVG, MIN and MAX are kept from.

For each group: the number of rows, and for each distinct argument the number of values and their
exact sum. Rows carry a sign, so a change is its old row at -1 and its new row at +1, and partials of
changes simply add up to partials of tables. A group lives while its number of rows is positive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions import exact
from deltaloom.functions.expressions import Compiler, first
from deltaloom.plans import types as S
from deltaloom.plans.nodes import Agg, Col, Expr
from deltaloom.plans.types import SqlType
from deltaloom.plans.typing import Scope, infer

N, SIGN = "__n", "__w"


@dataclass(frozen=True)
class Arg:
    """One distinct argument of COUNT, SUM and AVG."""

    i: int
    expr: Expr
    type: SqlType
    summed: bool
    side: str | None

    @property
    def family(self) -> str:
        return "float" if self.type.name in S.FLOATS else "interval" if self.type.name == "interval" else "exact"

    @property
    def sum_type(self) -> str:
        return "bigint" if self.type.name in ("smallint", "integer") else f"decimal(38,{self.type.scale if self.type.name == 'numeric' else 0})"

    def columns(self) -> dict[str, str]:
        """State columns and their Spark types."""
        out = {f"__c{self.i}": "bigint"}
        if self.summed:
            if self.family == "exact":
                out[f"__s{self.i}"] = self.sum_type
            elif self.family == "float":
                out[f"__f{self.i}"] = exact.SUMS
            else:
                out |= {f"__{part}{self.i}": "decimal(38,0)" for part in ("months", "days", "micros")}
        return out


class Partials:
    """The partial state of some fields. ``keys`` are the group's columns and their types."""

    def __init__(self, fields: tuple[tuple[str, Expr], ...], keys: dict[str, SqlType], scope: Scope):
        self.fields, self.keys, self.scope = fields, keys, scope
        self.aggs: list[Agg] = list(dict.fromkeys(x for _, e in fields for x in e.walk() if isinstance(x, Agg)))
        summed = {a.arg for a in self.aggs if a.name in ("SUM", "AVG")}
        exprs = list(dict.fromkeys(a.arg for a in self.aggs if a.arg is not None and a.name in ("COUNT", "SUM", "AVG")))
        self.args = [Arg(i, e, infer(e, scope), e in summed, next((x.table for x in e.walk() if isinstance(x, Col)), None)) for i, e in enumerate(exprs)]
        self.extremes: list[Agg] = [a for a in self.aggs if a.name in ("MIN", "MAX")]

    @property
    def columns(self) -> dict[str, str]:
        """The state's columns after the keys, and their Spark types."""
        out = {N: "bigint"}
        for a in self.args:
            out |= a.columns()
        return out | {f"__x{j}": S.to_spark(infer(a, self.scope)) for j, a in enumerate(self.extremes)}

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in [*((k, S.to_spark(v)) for k, v in self.keys.items()), *self.columns.items()]))

    def key_columns(self, at: str = "") -> dict[str, Column]:
        """The group's columns of source rows, which may stand in ``at``."""
        return {k: key_value(F.col(f"{at}.`{k}`" if at else f"`{k}`"), t) for k, t in self.keys.items()}

    def errors(self, compiler: Compiler) -> Column | None:
        """Why a row's arguments cannot be computed, if they cannot."""
        return first(compiler.value(a.expr).err for a in self.args)

    def of_rows(self, rows: DataFrame, keys: dict[str, Column], compiler: Compiler, sign: Column | None = None, args: list[Arg] | None = None) -> DataFrame:
        """Partials of ``rows`` by ``keys`` (names and columns). With ``sign``, also the extremes of what comes and of what goes."""
        args = self.args if args is None else args
        values = {a.i: compiler.value(a.expr).col for a in args}
        named = [c.alias(k) for k, c in keys.items()]
        made = [v.alias(f"__v{i}") for i, v in values.items()]
        extremes = [] if args is not self.args else [(j, a, compiler.value(a.arg).col) for j, a in enumerate(self.extremes)]
        rows = rows.select(*named, *([sign.alias(SIGN)] if sign is not None else []), *made, *[c.alias(f"__e{j}") for j, _, c in extremes])
        w = F.col(SIGN) if sign is not None else None
        count = (lambda ok: F.sum(F.when(ok, w).otherwise(0)).cast("bigint")) if w is not None else (lambda ok: F.count(F.when(ok, 1)))
        signed = (lambda x: F.when(w < 0, -x).otherwise(x)) if w is not None else (lambda x: x)
        out = [F.sum(w).cast("bigint").alias(N) if w is not None else F.count(F.lit(1)).alias(N)]
        floats: dict[str, Column] = {}
        for a in args:
            v = F.col(f"__v{a.i}")
            out.append(count(v.isNotNull()).alias(f"__c{a.i}"))
            if not a.summed:
                continue
            if a.family == "exact":
                wide = v if a.type.name != "bigint" else v.cast("decimal(19,0)")
                out.append(F.coalesce(F.sum(signed(wide)), F.lit(0)).cast(a.sum_type).alias(f"__s{a.i}"))
            elif a.family == "float":
                floats[f"__f{a.i}"] = v
            else:
                out += [F.coalesce(F.sum(signed(v[part].cast("decimal(20,0)"))), F.lit(0)).cast("decimal(38,0)").alias(f"__{part}{a.i}") for part in ("months", "days", "micros")]
        for j, a, _ in extremes:
            x = F.col(f"__e{j}")
            if w is None:
                out.append(extreme(a, self.kind(a), x).alias(f"__x{j}"))
            else:
                out += [extreme(a, self.kind(a), F.when(w > 0, x)).alias(f"__x{j}"), extreme(a, self.kind(a), F.when(w < 0, x)).alias(f"__r{j}")]
        names = list(keys)
        got = rows.groupBy(*[f"`{k}`" for k in names]).agg(*out)
        if floats:
            sums = exact.exact_float_sums(rows, names, floats, w if w is not None else F.lit(1))
            got = got.alias("a").join(sums.alias("b"), same(names), "left").select("a.*", *[F.coalesce(f"b.{c}", F.create_map().cast(exact.SUMS)).alias(c) for c in floats])
        return got

    def kind(self, a: Agg) -> SqlType:
        return infer(a, self.scope)

    def merged(self, changes: DataFrame, state: DataFrame) -> DataFrame:
        """For each changed group: keys, ``old`` state (NULL: there was none) and its ``new`` one, and ``probe``: an extreme may have gone."""
        names = list(self.keys)
        old = state.select(*[F.col(f"`{k}`") for k in names], F.struct(*[f"`{f.name}`" for f in self.schema]).alias("old"))
        both = changes.alias("d").join(old.alias("o"), same(names, "d", "o"), "left")
        new, probe = [], F.lit(False)
        for c, t in self.columns.items():
            o, d = F.col(f"o.old.{c}"), F.col(f"d.{c}")
            if t == exact.SUMS:
                x = exact.merge_sums(o, d)
            elif c.startswith("__x"):
                a = self.extremes[int(c[3:])]
                gone = F.col(f"d.__r{c[3:]}")
                probe = probe | (gone.isNotNull() & (o.isNull() | ~beyond(a, self.kind(a), o, gone)))
                x = better(a, self.kind(a), o, d)
            else:
                x = (F.coalesce(o, F.lit(0)) + F.coalesce(d, F.lit(0))).cast(t)
            new.append(x.alias(c))
        keys = [F.col(f"d.`{k}`") for k in names]
        return both.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col("o.old").alias("old"), F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)], *new).alias("new"), F.coalesce(probe, F.lit(False)).alias("probe"))

    def visible(self, state: DataFrame, types: dict[str, SqlType], prefix: str = "") -> list[Column]:
        """The target's columns from state columns (which may stand in the struct ``prefix``)."""
        at = f"{prefix}." if prefix else ""
        got = {i: self.final(a, at) for i, a in enumerate(self.aggs)}
        kinds = {f"__agg{i}": infer(a, self.scope) for i, a in enumerate(self.aggs)}
        inner = Scope(lambda t, n: kinds.get(n) or self.keys.get(n) or self.scope.column(t, n))
        compiler = Compiler(inner, lambda t, n: got[int(n[5:])] if n in kinds else F.col(f"{at}`{n}`"))
        number = {a: i for i, a in enumerate(self.aggs)}
        exprs = dict(self.fields)
        out = []
        for n, t in types.items():
            if n in self.keys and n not in exprs:
                c = F.col(f"{at}`{n}`")
            else:
                e = exprs[n].rewrite(lambda x: Col(f"__agg{number[x]}") if isinstance(x, Agg) else Col(x.name) if isinstance(x, Col) else None)
                c = compiler.value(e).col
            out.append(c.cast(S.to_spark(t)).alias(n))
        return out

    def final(self, a: Agg, at: str = "") -> Column:
        """An aggregate's value from the state."""
        if a.name in ("MIN", "MAX"):
            return F.col(f"{at}__x{self.extremes.index(a)}")
        if a.arg is None:
            return F.col(f"{at}{N}")
        arg = next(x for x in self.args if x.expr == a.arg)
        n = F.col(f"{at}__c{arg.i}")
        if a.name == "COUNT":
            return n
        some = lambda c: F.when(n > 0, c)
        if arg.family == "float":
            sums = some(F.col(f"{at}__f{arg.i}"))
            return exact.rounded_mean(sums, n) if a.name == "AVG" else exact.rounded_real_sum(sums) if arg.type.name == "real" else exact.rounded_sum(sums)
        if arg.family == "interval":
            months, days, micros = (F.col(f"{at}__{p}{arg.i}") for p in ("months", "days", "micros"))
            whole = F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("bigint").alias("micros"))
            return some(whole if a.name == "SUM" else exact.interval_mean(months, days, micros, n))
        total = F.col(f"{at}__s{arg.i}")
        if a.name == "SUM":
            return some(total)
        t = infer(a, self.scope)
        return some((total.cast(f"decimal(38,{t.scale if arg.type.name == 'numeric' and arg.type.scale >= 6 else arg.type.scale if arg.type.name == 'numeric' else 0})") / n).cast(f"decimal(38,{t.scale})"))

    def times(self, a: Arg, at: str, m: Column) -> list[Column]:
        """An argument's partials where every row of its side counts ``m`` times."""
        out = []
        for c, t in a.columns().items():
            x = F.col(f"{at}.{c}")
            if t == exact.SUMS:
                y = F.transform_values(x, lambda k, v: (v * m.cast("decimal(19,0)")).cast("decimal(38,0)"))
            elif t == "bigint":
                y = x * m
            elif int(scale := t.rpartition(",")[2].rstrip(")")) <= 6:  # Spark keeps so many decimals of an exact product
                y = (x * m.cast("decimal(19,0)")).cast(t)
            else:
                y = (x.cast(f"decimal(28,{scale})") * m.cast("decimal(9,0)")).cast(t)
            out.append(y.alias(c))
        return out

    def nothing(self, a: Arg) -> list[Column]:
        """An argument's partials of no rows."""
        return [(F.create_map().cast(t) if t == exact.SUMS else F.lit(0).cast(t)).alias(c) for c, t in a.columns().items()]

    def summed(self, parts: DataFrame, names: list[str] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
        """Partials of the same group (or of the same ``names``, with other ``columns``) added up, combined map-side; maps of sums by their powers, of which a group has some 2,000 at most."""
        keys = [f"`{k}`" for k in (self.keys if names is None else names)]
        columns = self.columns if columns is None else columns
        maps = [c for c, t in columns.items() if t == exact.SUMS]
        added = {c: t for c, t in columns.items() if c not in maps}
        if not maps:
            return parts.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in added.items()])
        kind = "array<struct<i:int,p:int,v:decimal(38,0)>>"
        numbered = lambda i: lambda x: F.struct(F.lit(i).alias("i"), x["key"].alias("p"), x["value"].alias("v"))
        entries = [F.transform(F.map_entries(c), numbered(i)).cast(kind) for i, c in enumerate(maps)]
        own = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("p"), F.lit(0).cast("decimal(38,0)").alias("v"))).cast(kind)
        each = parts.select(*keys, *added, F.explode(F.concat(own, *entries)).alias("__a"))
        once = [F.when(F.col("__a.i") == -1, F.col(c)).alias(c) for c in added]
        each = each.select(*keys, *once, F.col("__a.i").alias("__i"), F.col("__a.p").alias("__p"), F.col("__a.v").alias("__v"))
        by_power = each.groupBy(*keys, "__i", "__p").agg(*[F.sum(c).cast(t).alias(c) for c, t in added.items()], F.sum("__v").cast("decimal(38,0)").alias("__v"))
        made = [F.map_from_entries(F.collect_list(F.when((F.col("__i") == i) & (F.col("__v") != 0), F.struct("__p", "__v")))).cast(exact.SUMS).alias(c) for i, c in enumerate(maps)]
        out = by_power.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in added.items()], *made)
        return out.select(*keys, *columns)


def key_value(x: Column, t: SqlType) -> Column:
    """A group key as it is kept: char(n) without its padding, which its equality ignores."""
    return F.rtrim(x) if t.name == "bpchar" else x.cast(S.to_spark(t))


def same(names: list[str], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in names])


def order(t: SqlType, x: Column) -> Column:
    return exact.interval_micros(x) if t.name == "interval" else x


def extreme(a: Agg, t: SqlType, x: Column) -> Column:
    if t.name == "interval":
        return (F.min_by if a.name == "MIN" else F.max_by)(x, order(t, x))
    return F.min(x) if a.name == "MIN" else F.max(x)


def beyond(a: Agg, t: SqlType, x: Column, y: Column) -> Column:
    """Whether ``x`` is more extreme than ``y``."""
    return order(t, x) < order(t, y) if a.name == "MIN" else order(t, x) > order(t, y)


def better(a: Agg, t: SqlType, x: Column, y: Column) -> Column:
    return F.when(x.isNull(), y).when(y.isNull(), x).when(beyond(a, t, y, x), y).otherwise(x)
