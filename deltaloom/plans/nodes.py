"""Syntax trees of statements and expressions, and their text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

from deltaloom.plans.words import RESERVED


class Expr:
    """An expression. Children are the fields that hold expressions or tuples of them."""

    def children(self) -> Iterator[Expr]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Expr):
                yield v
            elif isinstance(v, tuple):
                for x in v:
                    if isinstance(x, Expr):
                        yield x
                    elif isinstance(x, tuple):
                        yield from (y for y in x if isinstance(y, Expr))

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def rewrite(self, f: Callable[[Expr], Expr | None]) -> Expr:
        """A copy in which every node that ``f`` gives a replacement for is replaced; replacements are not entered."""
        if (new := f(self)) is not None:
            return new

        def deep(v):
            if isinstance(v, Expr):
                return v.rewrite(f)
            return tuple(map(deep, v)) if isinstance(v, tuple) else v

        return replace(self, **{x.name: deep(getattr(self, x.name)) for x in fields(self)})


@dataclass(frozen=True)
class Col(Expr):
    name: str
    table: str | None = None  # as written before the dot: a table, an alias, or schema.table

    def __str__(self) -> str:
        return f"{quote_table(self.table)}.{quote(self.name)}" if self.table else quote(self.name)


@dataclass(frozen=True)
class Number(Expr):
    text: str  # digits with at most one point; a minus before it belongs to it

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Text(Expr):
    value: str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Bool(Expr):
    value: bool

    def __str__(self) -> str:
        return "TRUE" if self.value else "FALSE"


@dataclass(frozen=True)
class Null(Expr):
    def __str__(self) -> str:
        return "NULL"


@dataclass(frozen=True)
class Typed(Expr):
    """A typed literal, such as DATE '2024-01-31'."""

    type: str
    value: str

    def __str__(self) -> str:
        return f"{self.type.upper()} {Text(self.value)}"


@dataclass(frozen=True)
class Neg(Expr):
    x: Expr

    def __str__(self) -> str:
        return f"(- {self.x})"


@dataclass(frozen=True)
class Not(Expr):
    x: Expr

    def __str__(self) -> str:
        return f"(NOT {self.x})"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr

    def __str__(self) -> str:
        return f"({self.a} {self.op} {self.b})"


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool = False

    def __str__(self) -> str:
        return f"({self.x} IS {'NOT ' * self.negated}NULL)"


@dataclass(frozen=True)
class In(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool = False

    def __str__(self) -> str:
        return f"({self.x} {'NOT ' * self.negated}IN ({', '.join(map(str, self.items))}))"


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool = False

    def __str__(self) -> str:
        return f"({self.x} {'NOT ' * self.negated}BETWEEN {self.low} AND {self.high})"


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None

    def __str__(self) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in self.whens) + (f" ELSE {self.otherwise}" if self.otherwise else "") + " END"


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    to: str  # canonical type name

    def __str__(self) -> str:
        return f"CAST({self.x} AS {self.to})"


@dataclass(frozen=True)
class Call(Expr):
    name: str  # upper case
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Extract(Expr):
    field: str  # lower case
    x: Expr

    def __str__(self) -> str:
        return f"EXTRACT({self.field} FROM {self.x})"


@dataclass(frozen=True)
class Agg(Expr):
    name: str  # upper case
    arg: Expr | None  # None: *

    def __str__(self) -> str:
        return f"{self.name}({'*' if self.arg is None else self.arg})"


@dataclass(frozen=True)
class Table:
    name: str  # with its schema, if written
    key: tuple[str, ...] | None = None
    alias: str | None = None

    @property
    def bare(self) -> str:
        return self.name.rpartition(".")[2]

    @property
    def side(self) -> str:
        return self.alias or self.bare

    def __str__(self) -> str:
        return quote_table(self.name) + (f" KEY ({', '.join(map(quote, self.key))})" if self.key else "") + (f" AS {quote(self.alias)}" if self.alias else "")


@dataclass(frozen=True)
class Join:
    kind: str  # INNER or LEFT
    table: Table
    on: tuple[tuple[Col, Col], ...]  # (root's column, joined table's column) once resolved

    def __str__(self) -> str:
        return f"{self.kind} JOIN {self.table} ON " + " AND ".join(f"{a} = {b}" for a, b in self.on)


@dataclass(frozen=True)
class Transform:
    target: str
    source: Table
    joins: tuple[Join, ...]
    group_by: tuple[Col, ...]
    fields: tuple[tuple[str, Expr], ...]
    where: Expr | None = None
    without_index: bool = False
    adopt: bool = False
    grammar: int = 2

    @property
    def kind(self) -> str:
        """one_to_one, aggregate, join or join_one_to_one."""
        return ("join" if self.joins else "aggregate") if self.group_by else ("join_one_to_one" if self.joins else "one_to_one")

    @property
    def tables(self) -> list[Table]:
        return [self.source, *(j.table for j in self.joins)]

    def __str__(self) -> str:
        parts = [f"TRANSFORM {quote_table(self.target)}", "ADOPT EXISTING TABLE" if self.adopt else "", f"FROM {self.source}", *map(str, self.joins)]
        parts += [f"GROUP BY {', '.join(map(str, self.group_by))}" if self.group_by else "", "WITHOUT SOURCE INDEX" if self.without_index else ""]
        parts += ["SELECT " + ", ".join(f"{e} AS {quote(n)}" for n, e in self.fields), f"WHERE {self.where}" if self.where else ""]
        return " ".join(p for p in parts if p)


@dataclass(frozen=True)
class Alter:
    target: str
    changes: tuple[tuple[str, str, Expr | None], ...]  # (ADD, ALTER or DROP; field; expression)


@dataclass(frozen=True)
class Lifecycle:
    verb: str  # PAUSE, RESUME or DROP
    address: tuple[str, ...]  # names between dots


def quote(name: str) -> str:
    """A name as it has to be written: quoted unless it folds to itself and is no reserved word."""
    return name if re.fullmatch(r"[a-z_][a-z0-9_$]*", name) and name not in RESERVED else '"' + name.replace('"', '""') + '"'


def quote_table(name: str) -> str:
    return ".".join(map(quote, name.split(".")))
