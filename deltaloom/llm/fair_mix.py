"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source gets a target: its weight's share of the budget, filled up like water so that
no source is asked for more than ``max_repeats`` times what it has. Documents of a source
queue in a fixed pseudo-random order; copy ``e`` of a document finishes at the virtual time
``(e * source tokens + tokens queued up to and with it) / target``. All copies of all
sources are then range-sorted by finish time and the queue is cut where the running total
reaches the budget.

Rows that are equal in all that the queue knows of them (id, text, source) are one row with a count, so that thousands of
copies cost a row for each task. Both running totals are two-level sums, so that neither a hot source nor the global order
lands in one task: rows are dealt into ranges of the order (hash ranges in a source, ranges
of virtual time globally), ranges are summed first, and only the range that holds the cut
is sorted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.common import durable, row_hash

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges of one source, and ranges of one unit of virtual time.
HASH_RANGES, TIME_RANGES, LAST_RANGE = 8192, 32768, 4 * 32768


def size_of(text: Column) -> Column:
    """Words of ``text``; none for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_key(key: Column, text: Column, seed: str) -> Column:
    """60 pseudo-random bits of a row's id and text, the same in every run and engine; rows of the same (or no) id differ by their texts."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``sizes`` (m_source, source_size; a row per source) with each source's position and ``target``.

    The k sources with the smallest cap per weight are capped, where k is the least for
    which the rest's level stays under their caps. One row per source is sorted, never
    one per document.
    """
    w = F.lit(0)
    for i, x in enumerate(weights):
        w = F.when(F.col("m_at") % len(weights) == i, F.lit(x)).otherwise(w)
    every = Window.partitionBy()
    filling = every.orderBy("m_ratio", "m_at")
    return (
        sizes.withColumn("m_at", F.row_number().over(every.orderBy(F.col("m_source").asc_nulls_last())) - 1)
        .withColumn("m_weight", w.cast("long"))
        .withColumn("m_cap", F.col("source_size") * max_repeats)
        .withColumn("m_ratio", F.col("m_cap").cast("double") / F.col("m_weight"))
        .withColumn("m_total", F.sum("source_size").over(every))
        .withColumn("m_filled", F.coalesce(F.sum("m_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("m_open", F.sum("m_weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("m_level", (F.lit(float(share)) * F.col("m_total") - F.col("m_filled")) / F.col("m_open"))
        .withColumn("m_full", F.col("m_cap") <= F.col("m_level") * F.col("m_weight"))
        .withColumn("m_first", F.min(F.when(~F.col("m_full"), F.struct("m_ratio", "m_at", "m_level"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("m_first").isNull() | (F.struct("m_ratio", "m_at") < F.struct("m_first.m_ratio", "m_first.m_at")), F.col("m_cap").cast("double")).otherwise(F.col("m_first.m_level") * F.col("m_weight")),
        )
        .select("m_source", "source_size", "m_at", "target")
    )


def plan_mix(queue: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Decide how many copies of each row of ``queue`` the mix takes.

    ``queue`` has m_id, m_source (null is a source of its own, last in order), size (tokens,
    not null), m_hash (60 bits that order the queue) and any other narrow columns, all
    kept. Adds source_size, target (double) and copies (0 to ``max_repeats``).
    Ties in time fall to source order, copy, hash and id; rows equal in all columns of the queue are
    interchangeable and are taken or left together. A source without tokens has target 0 and its
    documents, of size 0, are taken. An empty queue gives an empty result.
    """
    decided = _decide(queue, weights, share, max_repeats)
    if decided.filter("m_equal > 1").isEmpty():
        return decided.drop("m_equal")
    on = F.expr(" AND ".join(f"q.`{c}` <=> d.`{c}`" for c in queue.columns))
    return queue.alias("q").join(decided.alias("d"), on).select("q.*", "d.source_size", "d.target", "d.copies")


def _decide(queue: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``plan_mix`` with one row for rows that are equal, and their number as m_equal."""
    if not 0 <= share <= max_repeats:
        raise ValueError("share must lie between 0 and max_repeats")
    queue = queue.groupBy(*queue.columns).agg(F.count("*").alias("m_equal")).withColumn("m_words", F.col("size") * F.col("m_equal"))
    by_range = F.shiftright("m_hash", 60 - HASH_RANGES.bit_length() + 1).alias("m_range")
    ranges = queue.groupBy("m_source", by_range).agg(F.sum("m_words").alias("m_sum"))
    ranges = durable(ranges)
    aims = targets(ranges.groupBy("m_source").agg(F.sum("m_sum").alias("source_size")), weights, share, max_repeats)
    before = Window.partitionBy("m_source").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("m_start", F.coalesce(F.sum("m_sum").over(before), F.lit(0))).drop("m_sum")
    starts = starts.alias("a").join(aims.alias("b"), F.expr("a.m_source <=> b.m_source")).select("a.*", "b.source_size", "b.m_at", "b.target")

    rows = queue.select("*", by_range).alias("q")
    rows = rows.join(starts.alias("s"), F.expr("q.m_source <=> s.m_source AND q.m_range = s.m_range")).select("q.*", "s.m_start", "s.source_size", "s.m_at", "s.target")
    upto = Window.partitionBy("m_source", "m_range").orderBy("m_hash", "m_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = durable(rows.withColumn("m_queued", F.col("m_start") + F.sum("m_words").over(upto)).drop("m_start", "m_range"))

    def key(e: Column) -> Column:
        finish = F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("m_queued")).cast("double") / F.col("target")).otherwise(F.lit(0.0))
        return F.struct(finish.alias("finish"), F.col("m_at").alias("at"), e.cast("int").alias("e"), F.col("m_hash").alias("h"), F.col("m_id").alias("id"))

    copies = rows.select(F.col("m_words").alias("size"), F.explode(F.array(*[key(F.lit(e)) for e in range(max_repeats)])).alias("k"))
    copies = copies.withColumn("slot", F.least(F.floor(F.col("k.finish") * TIME_RANGES), F.lit(LAST_RANGE)))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("s"))
    order = Window.partitionBy().orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("upto", F.sum("s").over(order))
    budget = (aims.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    crossing = slots.filter(F.col("upto") > budget).orderBy("slot").limit(1).select("slot", (F.col("upto") - F.col("s")).alias("upto")).first()
    taken = F.lit(max_repeats)
    if crossing is not None:
        inside = Window.partitionBy("slot").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        cut = copies.filter(F.col("slot") == crossing["slot"]).withColumn("upto", F.sum("size").over(inside) + crossing["upto"])
        last = cut.filter(F.col("upto") <= budget).agg(F.max("k").alias("k")).first()["k"]
        within = [F.floor(key(F.lit(e))["finish"] * TIME_RANGES) for e in range(max_repeats)]
        if last is None:
            taken = sum((F.when(w < crossing["slot"], 1).otherwise(0) for w in within), F.lit(0))
        else:
            at = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["at"]).alias("at"), F.lit(last["e"]).alias("e"), F.lit(last["h"]).alias("h"), F.lit(last["id"]).cast(queue.schema["m_id"].dataType).alias("id"))
            taken = sum((F.when(key(F.lit(e)) <= at, 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    return rows.withColumn("copies", taken.cast("int")).drop("m_queued", "m_at", "m_words")


def queue_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix:", keep: dict[str, Column] | None = None) -> DataFrame:
    """The narrow rows that ``plan_mix`` takes, of documents with any other columns; ids and sources may be null, and null text counts no words."""
    own = [F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{source_col}`").cast("string").alias("m_source"), size_of(F.col(f"`{text_col}`")).alias("size"), shuffle_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("m_hash")]
    return durable(docs.select(*own, *[c.alias(n) for n, c in (keep or {}).items()]))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, with its own columns.

    Rows equal in every column share one decision, the largest that any of them got.
    Takes the options of ``queue_of`` and ``plan_mix``.
    """
    plan = {"weights": (5, 2, 1), "share": 1.5, "max_repeats": 2}
    plan |= {k: options.pop(k) for k in plan if k in options}
    row = row_hash(docs)
    id_col = options.get("id_col", "doc_id")
    decided = _decide(queue_of(docs, keep={"m_row": row}, **options), **plan)
    decided = decided.groupBy("m_id", "m_row").agg(F.max("copies").alias("m_copies")).filter("m_copies > 0")
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("d"), row.alias("row"))
    joined = own.join(decided, F.col(f"d.`{id_col}`").eqNullSafe(F.col("m_id")) & (F.col("row") == F.col("m_row")))
    return joined.select("d", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("d.*")
