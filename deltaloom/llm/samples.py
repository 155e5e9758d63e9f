"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are not drawn into a training sample, or cut for it by language ID (they are scored whole, like any other).
SAMPLE_CHARS = 20_000
GRAIN = 1_000_000


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's decimal text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def draw(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``label``, chosen by a hash of ``key``, so the same rows in every run.

    A row is drawn by its own hash and the label's count alone: nothing is sorted, and
    a label that is most of the table costs no more than another.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(GRAIN, -(-most * GRAIN // max(1, n)))))])
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(GRAIN)) < share[F.col(label)])


def within_chars(rows: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """Those of a few drawn rows, by a hash of ``key``, whose texts come to about ``most`` characters for each value of ``label``."""
    sizes = {r[0]: r[1] or 0 for r in rows.groupBy(label).agg(F.sum(F.length(text))).collect()}
    if not sizes:
        return rows
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(GRAIN, -(-most * GRAIN // max(1, n)))))])
    return rows.filter(F.pmod(F.xxhash64(F.lit("characters"), F.col(key)), F.lit(GRAIN)) < share[F.col(label)])
