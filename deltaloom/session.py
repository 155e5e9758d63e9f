"""One-off use: run statements over DataFrames without an engine, chains included."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from deltaloom.errors import refuse
from deltaloom.operators.full import full
from deltaloom.plans import types as S
from deltaloom.plans.definition import Checked, Relation, check
from deltaloom.plans.nodes import Transform
from deltaloom.plans.parser import parse


@dataclass
class Session:
    """Tables and targets by name. Targets are lazy DataFrames; nothing runs before an action."""

    relations: dict[str, Relation] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, name: str, rows: DataFrame, key: list[str], *, unique: tuple[tuple[str, ...], ...] = (), partitions: tuple[str, ...] = (), types: dict[str, str] | None = None, labels: dict[str, tuple[str, ...]] | None = None) -> Session:
        columns = {f.name: S.of_spark(f.dataType, (types or {}).get(f.name)) for f in rows.schema}
        self.relations[name] = Relation(name, columns, tuple(key), unique, partitions, labels=labels or {})
        self.frames[name] = rows
        return self

    def _find(self, name: str) -> Relation:
        bare = name.rpartition(".")[2]
        if bare not in self.relations:
            if near := [x for x in self.relations if x.lower() == bare.lower()]:
                raise refuse("NameCaseMismatch", f'{name}: did you mean "{near[0]}"?')
            raise refuse("SourceTableNotFound", name)
        return self.relations[bare]

    def check(self, text: str) -> Checked:
        t = parse(text)
        if not isinstance(t, Transform):
            raise refuse("UnexpectedToken", "a TRANSFORM statement is needed here")
        return check(t, self._find)

    def transform(self, text: str) -> DataFrame:
        """The target of a definition; later definitions may read it by its name."""
        d = self.check(text)
        out = full(d, lambda n: self.frames[n.rpartition(".")[2]])
        name = d.target.rpartition(".")[2]
        self.relations[name], self.frames[name] = d.as_relation(), out
        return out
