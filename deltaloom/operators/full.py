"""Definitions as whole-table queries: what a build computes, and what every target has to equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import exact
from deltaloom.functions.expressions import Compiler, first
from deltaloom.operators.partials import N, Arg, Partials, key_value
from deltaloom.plans import types as S
from deltaloom.plans.definition import Checked
from deltaloom.plans.nodes import Expr

Frames = Callable[[str], DataFrame]
ERROR = "__error"


def compiler_of(d: Checked, guard: bool = False, at: str = "") -> Compiler:
    """Columns by their side: a single table's stand alone (or in the struct ``at``), a JOIN's in the alias of their side."""
    one = not d.text.joins
    return Compiler(d.scope, lambda t, n: F.col(f"{at}.`{n}`" if at else f"`{n}`" if one else f"`{t}`.`{n}`"), guard)


def side_compiler(d: Checked, at: str = "") -> Compiler:
    """Columns of one side of a JOIN that is read alone."""
    return Compiler(d.scope, lambda t, n: F.col(f"{at}.`{n}`" if at else f"`{n}`"))


def full(d: Checked, frames: Frames, guard: bool = False) -> DataFrame:
    """The whole target, from the tables that ``frames`` gives by name."""
    if d.kind in ("one_to_one", "join_one_to_one"):
        out = rows_of(d, joined(d, frames), guard)
        return out if guard else out.drop(ERROR)
    state = full_state(d, frames, guard)
    return state.select(*Partials(d.fields, key_types(d), d.scope).visible(state, d.types))


def key_types(d: Checked) -> dict:
    return {k: d.types[k] for k in d.key}


# one row for each row


def joined(d: Checked, frames: Frames, root: DataFrame | None = None) -> DataFrame:
    """The root table, or its rows ``root``, joined to the others on their unique keys; each in the alias of its side."""
    t = d.text
    root = frames(t.source.name) if root is None else root
    if not t.joins:
        return root
    out = root.alias(t.source.side)
    for j in t.joins:
        on = reduce(lambda a, b: a & b, [F.col(f"`{a.table}`.`{a.name}`") == F.col(f"`{b.table}`.`{b.name}`") for a, b in j.on])
        out = out.join(frames(j.table.name).alias(j.table.side), on, j.kind.lower())
    return out


def rows_of(d: Checked, rows: DataFrame, guard: bool = False, only: list[str] | None = None) -> DataFrame:
    """The target's rows from source rows: members of WHERE, key and fields. In guard mode ``__error`` has (field, SQLSTATE) of the first field that fails, and nothing raises."""
    c = compiler_of(d, guard)
    if d.text.where is not None:
        rows = rows.filter(c.value(d.text.where).col)
    root = None if not d.text.joins else d.text.source.side
    keys = [c.column(root, k).cast(S.to_spark(d.types[k])).alias(k) for k in d.key]
    values = {n: c.value(e) for n, e in d.fields if only is None or n in only}
    fields = [v.col.cast(S.to_spark(d.types[n])).alias(n) for n, v in values.items()]
    failed = first(F.when(v.err.isNotNull(), F.struct(F.lit(n).alias("field"), v.err.alias("state"))) for n, v in values.items() if v.err is not None)
    none = F.lit(None).cast("struct<field:string,state:string>")
    return rows.select(*keys, *fields, (none if failed is None else failed).alias(ERROR))


def row_image(d: Checked, at: str) -> Column:
    """The target's row, as a struct, from a row of its only table in the struct ``at``; NULL without one, and outside of WHERE. No field may be able to fail."""
    c = compiler_of(d, True, at)
    kept = F.col(at).isNotNull()
    if d.text.where is not None:
        kept = kept & c.value(d.text.where).col
    exprs = dict(d.fields)
    cells = [(c.value(exprs[n]).col if n in exprs else c.column(None, n)).cast(S.to_spark(t)).alias(n) for n, t in d.types.items()]
    return F.when(kept, F.struct(*cells))


def can_fail(d: Checked, only: list[str] | None = None) -> bool:
    """Whether a field of a one-row-for-each-row definition can fail on some row."""
    c = compiler_of(d, True)
    return any(c.value(e).err is not None for n, e in d.fields if only is None or n in only)


# groups


def full_state(d: Checked, frames: Frames, guard: bool = False) -> DataFrame:
    """The partial state of an aggregate or join aggregate. In guard mode rows of one table whose arguments fail are left out."""
    p = Partials(d.fields, key_types(d), d.scope)
    if d.kind == "aggregate":
        rows = frames(d.text.source.name)
        c = compiler_of(d, guard)
        if d.text.where is not None:
            rows = rows.filter(c.value(d.text.where).col)
        if (err := p.errors(c)) is not None:
            rows = rows.filter(err.isNull())
        return p.of_rows(rows, p.key_columns(), c)
    j = JoinPlan(d)
    left, right = (j.side(s, frames(t.name)) for s, t in enumerate(d.text.tables))
    return j.total(j.matched(left, right, j.outer))


class JoinPlan:
    """A join aggregate as two pre-aggregated sides: P by (left group, join key), M by (right group, join key), T = sum over keys of P x M."""

    def __init__(self, d: Checked):
        self.d, self.join = d, d.text.joins[0]
        self.outer = self.join.kind == "LEFT"
        self.sides = [d.text.source.side, self.join.table.side]
        self.p = Partials(d.fields, key_types(d), d.scope)
        self.on = [[a.name for a, _ in self.join.on], [b.name for _, b in self.join.on]]
        self.groups = [[c.name for c in d.text.group_by if c.table == s] for s in self.sides]
        self.where: list[Expr | None] = [d.left_where, d.right_where]
        self.args: list[list[Arg]] = [[a for a in self.p.args if a.side in ((s, None) if i == 0 else (s,))] for i, s in enumerate(self.sides)]
        self.k = [f"__k{i}" for i in range(len(self.join.on))]

    def keys(self, s: int, at: str = "") -> dict[str, Column]:
        col = lambda n: F.col(f"{at}.`{n}`" if at else f"`{n}`")
        return {g: key_value(col(g), self.d.types[g]) for g in self.groups[s]} | {k: col(n) for k, n in zip(self.k, self.on[s], strict=True)}

    def keep(self, s: int, rows: DataFrame, at: str = "") -> DataFrame:
        """Rows of a side that can count: members of its part of WHERE, and with a join key unless an outer join keeps them."""
        if self.where[s] is not None:
            rows = rows.filter(side_compiler(self.d, at).value(self.where[s]).col)
        if s == 1 or not self.outer:
            for n in self.on[s]:
                rows = rows.filter(F.col(f"{at}.`{n}`" if at else f"`{n}`").isNotNull())
        return rows

    def side(self, s: int, rows: DataFrame, sign: Column | None = None, at: str = "") -> DataFrame:
        """P (s = 0) or M (s = 1) of a side's rows."""
        return self.p.of_rows(self.keep(s, rows, at), self.keys(s, at), side_compiler(self.d, at), sign, self.args[s])

    def side_columns(self, s: int) -> dict[str, str]:
        """Columns of P or M and their Spark types."""
        relation = self.d.relations[s]
        out = {g: S.to_spark(self.d.types[g]) for g in self.groups[s]} | {k: spark_of(relation.columns[n]) for k, n in zip(self.k, self.on[s], strict=True)} | {N: "bigint"}
        for a in self.args[s]:
            out |= a.columns()
        return out

    def side_key(self, s: int) -> list[str]:
        return [*self.groups[s], *self.k]

    def matched(self, left: DataFrame, right: DataFrame, outer: bool = False) -> DataFrame:
        """Partials of every pair of cells that share a join key and, for an outer join, of the left cells without one, whose right side is nothing once; right cells are added up then."""
        on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in self.k])
        both = left.alias("l").join(right.alias("r"), on, "left" if outer else "inner")
        own = [F.col(f"l.`{g}`") if g in self.groups[0] else F.col(f"r.`{g}`") for g in self.p.keys]
        n = F.coalesce(F.col(f"r.{N}"), F.lit(1).cast("bigint")) if outer else F.col(f"r.{N}")
        parts = [x for a in self.args[0] for x in self.p.times(a, "l", n)]
        for a in self.args[1]:
            made = self.p.times(a, "r", F.col(f"l.{N}"))
            parts += [F.coalesce(x, none).alias(c) for x, none, c in zip(made, self.p.nothing(a), a.columns(), strict=True)] if outer else made
        return self.ordered(both.select(*own, (F.col(f"l.{N}") * n).alias(N), *parts))

    def cells(self, s: int, rows: DataFrame) -> DataFrame:
        """Rows of P or M added up by cell; cells of nothing are gone."""
        columns = {c: t for c, t in self.side_columns(s).items() if c not in self.side_key(s)}
        return self.p.summed(rows, self.side_key(s), columns).filter(self.something(s))

    def something(self, s: int) -> Column:
        """Whether a row of P or M adds anything."""
        columns = {c: t for c, t in self.side_columns(s).items() if c not in self.side_key(s)}
        return reduce(lambda a, b: a | b, [F.size(c) > 0 if t == exact.SUMS else F.col(c) != 0 for c, t in columns.items()])

    def present(self, right: DataFrame) -> DataFrame:
        """Join keys that M, of which rows may add up, has rows for."""
        return right.groupBy(*self.k).agg(F.sum(N).alias(N)).filter(F.col(N) > 0).select(*self.k)

    def nothing(self, keys: DataFrame, times: Column) -> DataFrame:
        """Rows of M that stand for no right side of some join keys, so many times."""
        types = self.side_columns(1)
        own = [F.lit(None).cast(types[g]).alias(g) for g in self.groups[1]]
        return keys.select(*own, *self.k, times.cast("bigint").alias(N), *[x for a in self.args[1] for x in self.p.nothing(a)])

    def ordered(self, parts: DataFrame) -> DataFrame:
        return parts.select(*[f"`{k}`" for k in self.p.keys], *self.p.columns)

    def total(self, *parts: DataFrame) -> DataFrame:
        return self.p.summed(reduce(DataFrame.unionByName, parts))


def spark_of(t) -> str:
    return f"decimal({t.precision},{t.scale})" if t.name == "numeric" else S.to_spark(t)
