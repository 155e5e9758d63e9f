"""Change records: folding by key, signed sides, and the delta rules of every kind of definition.

A change is (op, seq, change_id, old, new) with whole rows as images; ``old`` is NULL of an
insert and ``new`` of a delete. Operators return the affected keys, and what the target holds for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.full import ERROR, JoinPlan, compiler_of, joined, rows_of
from deltaloom.operators.partials import SIGN, Partials
from deltaloom.plans.definition import Checked
from deltaloom.plans.nodes import Col

OPS = ("insert", "update", "delete", "recompute", "truncate")


def images(changes: DataFrame, key: tuple[str, ...], floor: int | None) -> DataFrame:
    """Changes with images; an update of the key becomes a delete and an insert. Changes up to ``floor``, the last truncate, are gone."""
    if floor is not None:
        changes = changes.filter(F.col("seq") > F.lit(floor))
    return split_moved(changes.filter("op IN ('insert', 'update', 'delete')"), key)


def split_moved(changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Changes in which a change of ``key`` is a delete and an insert."""
    moved = reduce(lambda a, b: a | b, [~F.col(f"old.`{k}`").eqNullSafe(F.col(f"new.`{k}`")) for k in key])
    none_old, none_new = (F.lit(None).cast(changes.schema[c].dataType) for c in ("old", "new"))
    both = F.when(
        F.col("old").isNotNull() & F.col("new").isNotNull() & moved,
        F.array(F.struct(F.col("old"), none_new.alias("new")), F.struct(none_old.alias("old"), F.col("new"))),
    ).otherwise(F.array(F.struct("old", "new")))
    return changes.select("seq", "change_id", F.explode(both).alias("c")).select("seq", "change_id", "c.old", "c.new")


def key_of(key: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(f"new.`{k}`"), F.col(f"old.`{k}`")).alias(k) for k in key]


def fold(imaged: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One net change for each key: the first old image and the last new one. Keys that end as they began are gone."""
    at = F.struct("seq", "change_id")
    got = imaged.select(*key_of(key), at.alias("at"), "old", "new").groupBy(*[f"`{k}`" for k in key])
    net = got.agg(F.min_by("old", "at").alias("old"), F.max_by("new", "at").alias("new"))
    return net.filter(~F.col("old").eqNullSafe(F.col("new")))


def sides(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Every image as a row with its sign, cut down to ``columns``; changes of none of them are skipped."""
    cut = lambda side: F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns]))
    pruned = changes.select(cut("old").alias("old"), cut("new").alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
    signed = F.array(F.struct(F.lit(-1).alias(SIGN), F.col("old").alias("r")), F.struct(F.lit(1).alias(SIGN), F.col("new").alias("r")))
    return pruned.select(F.explode(signed).alias("s")).select(f"s.{SIGN}", "s.r").filter("r IS NOT NULL")


# one row for each row


def one_to_one(d: Checked, net: DataFrame, guard: bool) -> tuple[DataFrame, DataFrame]:
    """Keys of the net changes, and the target's rows for them."""
    new = net.filter("new IS NOT NULL").select("new.*")
    return net.select(*[f"`{k}`" for k in d.key]), rows_of(d, new, guard)


def join_one_to_one(d: Checked, nets: dict[str, DataFrame], snapshots, guard: bool) -> tuple[DataFrame, DataFrame]:
    """Root keys that a change of any table reaches, and the target's rows for them, from the tables as they are now."""
    t = d.text
    root = snapshots(t.source.name)
    keys = [f"`{k}`" for k in d.key]
    reached = []
    if t.source.name in nets:
        reached.append(nets[t.source.name].select(*keys))
    for j in t.joins:
        if j.table.name in nets:
            net = nets[j.table.name]
            ends = net.select(F.explode(F.array("old", "new")).alias("r")).filter("r IS NOT NULL").select(*[F.col(f"r.`{b.name}`").alias(f"__k{i}") for i, (_, b) in enumerate(j.on)]).distinct()
            on = reduce(lambda a, b: a & b, [F.col(f"a.`{a_.name}`") == F.col(f"e.__k{i}") for i, (a_, _) in enumerate(j.on)])
            reached.append(root.alias("a").join(ends.alias("e"), on, "left_semi").select(*keys))
    affected = reduce(DataFrame.unionByName, reached).distinct()
    on = reduce(lambda a, b: a & b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"k.`{k}`")) for k in d.key])
    rows = root.alias("a").join(affected.alias("k"), on, "left_semi")
    return affected, rows_of(d, joined(d, snapshots, rows), guard)


# groups


def read_columns(d: Checked, s: int = 0) -> list[str]:
    """Columns of the s-th table that the definition reads, its group and join keys included."""
    side = d.text.tables[s].side
    exprs = [e for _, e in d.fields] + [e for e in (d.text.where,) if e is not None] + list(d.text.group_by)
    found = [x.name for e in exprs for x in e.walk() if isinstance(x, Col) and (not d.text.joins or x.table == side)]
    found += [pair[1 if s else 0].name for i, j in enumerate(d.text.joins) if s in (0, i + 1) for pair in j.on]
    return list(dict.fromkeys(found))


def aggregate(d: Checked, p: Partials, changes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Partials of the changes, and the sides that fail (r, state), if any can."""
    c = compiler_of(d, True, "r")
    err, key = p.errors(c), list(d.relations[0].key)
    columns = read_columns(d)
    if err is not None or not columns:  # rows that fail are named by their key
        columns = list(dict.fromkeys([*columns, *key]))
    rows = sides(changes, columns)
    if d.text.where is not None:
        rows = rows.filter(c.value(d.text.where).col)
    failed = None
    if err is not None:
        rows = rows.withColumn(ERROR, err)
        failed = rows.filter(F.col(ERROR).isNotNull()).select(SIGN, "r", F.col(ERROR).alias("state"))
        rows = rows.filter(F.col(ERROR).isNull())
    return p.of_rows(rows, p.key_columns("r"), c, F.col(SIGN)), failed


def probed(d: Checked, p: Partials, groups: DataFrame, source: DataFrame) -> DataFrame:
    """State of the groups whose extreme may have gone, from the source as it is now."""
    on = reduce(lambda a, b: a & b, [x.eqNullSafe(F.col(f"b.`{k}`")) for k, x in p.key_columns("a").items()])
    rows = source.alias("a").join(groups.alias("b"), on, "left_semi")
    c = compiler_of(d, True)
    if d.text.where is not None:
        rows = rows.filter(c.value(d.text.where).col)
    if (err := p.errors(c)) is not None:
        rows = rows.filter(err.isNull())
    return p.of_rows(rows, p.key_columns(), c)


def join_delta(j: JoinPlan, dp: DataFrame | None, dm: DataFrame | None, p_old: DataFrame, m_old: DataFrame, m_new: DataFrame) -> DataFrame:
    """Partials that T gains: dP x M_new + P_old x dM, and for an outer join the left cells that lose or find their only match.

    The states may be cut down to join keys that dP or dM hold, and a cell may stand in several rows that add up.
    """
    parts = []
    if dp is not None:
        parts.append(j.matched(dp, j.cells(1, m_new) if j.outer else m_new, j.outer))
    if dm is not None:
        if j.outer:
            k = dm.select(*j.k).distinct()
            had, has = (j.present(m).withColumn(name, F.lit(True)) for m, name in ((m_old, "had"), (m_new, "has")))
            flips = k.join(had, j.k, "left").join(has, j.k, "left").filter(F.coalesce("had", F.lit(False)) != F.coalesce("has", F.lit(False)))
            dm = dm.unionByName(j.nothing(flips, F.when(F.coalesce("has", F.lit(False)), -1).otherwise(1)))
        parts.append(j.matched(p_old, dm))
    return j.total(*parts)
