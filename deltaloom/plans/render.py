"""A checked definition as one SELECT: what its whole target has to equal, as text that does not depend on our compiler."""

from __future__ import annotations

from deltaloom.plans.definition import Checked
from deltaloom.plans.nodes import Col, quote, quote_table


def target_select_sql(d: Checked) -> str:
    """SQL in the statement's own dialect, over the tables by name."""
    t = d.text
    side = t.source.side
    one = not t.joins
    fields = dict(d.fields)
    grouped = {c.name: c for c in t.group_by}
    items = []
    for n in d.types:
        e = fields.get(n) or grouped.get(n) or Col(n, None if one else side)
        items.append(f"{e} AS {quote(n)}")
    sql = f"SELECT {', '.join(items)} FROM {quote_table(t.source.name)}" + (f" AS {quote(side)}" if not one else "")
    for j in t.joins:
        sql += f" {j.kind} JOIN {quote_table(j.table.name)} AS {quote(j.table.side)} ON " + " AND ".join(f"{a} = {b}" for a, b in j.on)
    if t.where is not None:
        sql += f" WHERE {t.where}"
    if t.group_by:
        sql += " GROUP BY " + ", ".join(map(str, t.group_by))
    return sql
