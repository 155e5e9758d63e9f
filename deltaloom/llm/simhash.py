"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints at Hamming distance at most 3 agree in one of four blocks of 16 bits, so
each distinct fingerprint is dealt to its four (block, value) groups. A group that is too
large for one task is dealt again, by four blocks of the bits that its members do not share
already (again one of them must agree), level by level; no link is lost and no group is cut.

Inside a task, each group is an index: its codes stand in the order of their rank in the
binary-reflected Gray code, runs of 16 neighbours become nodes, and so do runs of nodes. A node keeps
the bit pattern that all codes below it share, less what its parent has already. Queries go down
with the differences counted so far and drop whole nodes beyond 3, and nodes whose codes are
all known to be in the query's own component, which keeps dense groups near-linear. A task returns a
spanning star of each component, never pairs; the stars are joined to components by label
propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import computed, durable, row_hash, slices, unused

SEED, BITS, DISTANCE, FAN = 42, 64, 3, 16
#: Codes in a group beyond which it is dealt again, and rows of one task.
GROUP, TASK_ROWS = 50_000, 100_000
#: (query, node) pairs that an index looks at together.
FRONTIER = 1_000_000
FULL = (1 << 64) - 1
#: A code that stands in more than one of so many rows is joined by broadcast.
HEAVY = 1000


def fingerprint(text: str) -> int:
    """64-bit SimHash over the 3-word shingles, repeats included, of a text lower-cased in A-Z."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = [h(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:], strict=False)] if len(words) > 2 else [h(b" ".join(words), SEED)]
    total, n = np.zeros(BITS, np.int64), len(hashes)
    codes = np.array(hashes, np.uint64)
    for i in range(0, n, 65536):
        part = codes[i : i + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``code`` (the fingerprint's bits as a signed long) and the kept columns of each row; null text has no words."""
    own = [F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep]]
    rows = docs.select(*own, F.col(f"`{text_col}`").alias(unused(docs, "m_text")))
    return computed(rows, "code bigint", lambda texts: [(signed(fingerprint(t)),) for t in texts])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code in the binary-reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(s))
    return codes


def compress(labels: np.ndarray) -> np.ndarray:
    while True:
        nearer = labels[labels]
        if np.array_equal(nearer, labels):
            return labels
        labels = nearer


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of the pairs (a, b); a label is the component's least index."""
    while a.size:
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        labels = compress(labels)
    return labels


class GrayIndex:
    """Hierarchical index over groups of codes, and their components at a distance of at most ``most``."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, most: int = DISTANCE):
        """``codes`` (uint64) stand by group, then by Gray rank; ``groups`` numbers each code's group from 0 upwards."""
        self.codes, self.groups, self.most = codes, groups, most
        self.levels: list[dict] = []
        low, high, group = codes, codes, groups
        first, last = np.arange(codes.size), np.arange(codes.size)
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if group.size else np.zeros(0, int)
            self.levels.append({"mask": ~(low ^ high), "pattern": low, "first": first, "last": last, "group": group})
            if starts.size == group.size:
                break
            within = np.arange(group.size) - np.repeat(starts, np.diff(np.r_[starts, group.size]))
            heads = np.flatnonzero(within % FAN == 0)
            ends = np.r_[heads[1:], group.size]
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            parent = np.repeat(np.arange(heads.size), ends - heads)
            self.levels[-1]["own"] = self.levels[-1]["mask"] & (low ^ high)[parent]
            first, last, group = first[heads], last[ends - 1], group[heads]
            self.levels.append({"heads": heads, "ends": ends})
        # (child level, children of each node) pairs, from the top downwards
        self.steps = [(self.levels[i - 2], self.levels[i - 1]) for i in range(len(self.levels) - 1, 0, -2)]

    def components(self) -> np.ndarray:
        """For each code the least index of its component."""
        n = self.codes.size
        labels = np.arange(n)
        if n < 2:
            return labels
        near = (np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= self.most) & (self.groups[1:] == self.groups[:-1])
        labels = unite(labels, np.flatnonzero(near), np.flatnonzero(near) + 1)
        cost = np.bincount(self.groups)[self.groups]
        for part in slices(cost, FRONTIER):
            queries = np.arange(part.start, part.stop)
            a, b = self.search(queries[cost[part] > 1], labels)
            labels = unite(labels, a, b)
        return labels

    def search(self, queries: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later code) within the distance and not known to be in one component."""
        query, node, sofar = queries, self.groups[queries], np.zeros(queries.size, np.uint8)
        for level, links in self.steps:
            lows = np.minimum.reduceat(labels, level["first"])
            one = lows == np.maximum.reduceat(labels, level["first"])
            n = links["ends"][node] - links["heads"][node]
            child = np.repeat(links["heads"][node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            query, sofar = np.repeat(query, n), np.repeat(sofar, n)
            live = (level["last"][child] > query) & ~(one[child] & (lows[child] == labels[query]))
            query, sofar, child = query[live], sofar[live], child[live]
            sofar = sofar + np.bitwise_count((self.codes[query] ^ level["pattern"][child]) & level["own"][child])
            live = sofar <= self.most
            query, sofar, node = query[live], sofar[live], child[live]
        return query, node


def split_mask(mask: int, parts: int = DISTANCE + 1) -> list[int]:
    """``mask`` joined with each of ``parts`` blocks of the bits outside of it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(nodes: DataFrame, most: int = GROUP, levels: int = 6) -> DataFrame:
    """Rows (code, mask): the groups to search, each being the codes equal under a mask.

    Every level takes a quarter of the bits that are free: after the sixth 12 are left, which at most 4,096 different codes share.
    """
    masks = split_mask(0)
    rows = nodes.select("code", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    done = []
    for _ in range(levels - 1):
        sizes = rows.groupBy("mask", F.col("code").bitwiseAND(F.col("mask")).alias("key")).count().filter(F.col("count") > most).drop("count")
        sizes = durable(sizes)
        if sizes.isEmpty():
            break
        keyed = rows.withColumn("key", F.col("code").bitwiseAND(F.col("mask")))
        done.append(keyed.join(sizes, ["mask", "key"], "left_anti").select("code", "mask"))
        finer = F.create_map(*[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(s)) for s in split_mask(m)]))])
        rows = keyed.join(sizes, ["mask", "key"], "left_semi").select("code", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        masks = list(dict.fromkeys(s for m in masks for s in split_mask(m)))  # two masks may lead to the same finer one
    return reduce(DataFrame.unionByName, [*done, rows])


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of all groups of a task, a star (a, b) for each component."""
    rows = [(pdf["code"].to_numpy(np.int64), pdf["mask"].to_numpy(np.int64)) for pdf in batches]
    codes, masks = (np.concatenate([np.zeros(0, np.int64), *x]).view(np.uint64) for x in (zip(*rows, strict=True) if rows else ((), ())))
    keys = codes & masks
    order = np.lexsort((gray_rank(codes), keys, masks))
    codes, keys, masks = codes[order], keys[order], masks[order]
    groups = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]) | (masks[1:] != masks[:-1])])[: codes.size]
    labels = GrayIndex(codes, groups).components()
    inner = labels != np.arange(codes.size)
    yield pd.DataFrame({"a": codes[inner].view(np.int64), "b": codes[labels[inner]].view(np.int64)}).drop_duplicates()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node that can be reached."""
    links = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        best = links.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(best, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        stepped = durable(stepped.join(jump, "label", "left").select("node", "was", F.least("label", "root").alias("label")))
        labels = stepped.select("node", "label")
        if stepped.filter("label <> was").isEmpty():
            return labels


def near_duplicates(coded: DataFrame, *, id_col: str = "doc_id", label_col: str | None = None) -> DataFrame:
    """Add ``component_id`` to rows with ids and ``code``: the least id among all rows that links reach; as ``label_col``, if
    named, the component's least code, which no other component has even where ids repeat or are null.

    Rows of equal codes are linked, also those without words (code 0). Null ids take part in links but are
    never a component's name, unless all of its ids are null. An empty table gives an empty result. ``coded``
    is read several times and should be durable.
    """
    nodes = durable(coded.groupBy("code").agg(F.min(f"`{id_col}`").alias("m_least"), F.count(F.lit(1)).alias("m_rows")))
    dealt = durable(deal(nodes))
    n = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // TASK_ROWS)
    dealt = dealt.repartition(n, "mask", F.col("code").bitwiseAND(F.col("mask")))
    labels = components(durable(dealt.mapInPandas(stars, "a bigint, b bigint").distinct()))
    linked = labels.join(nodes, labels["node"] == nodes["code"]).select("code", "label", "m_least")
    least = linked.groupBy("label").agg(F.min("m_least").alias("component_id"))
    named = linked.join(least, "label").select("code", "label", "component_id")
    label = [F.coalesce("label", "code").alias(label_col)] if label_col else []
    named = durable(nodes.join(named, "code", "left").select("code", F.coalesce("component_id", "m_least").alias("component_id"), *label, "m_rows"))
    # a code with more than a thousandth of the rows would be one task's; there are under a thousand of them. Of the others
    # Spark's skew join splits large ones, as the other side has one row for each code
    few = (named.agg(F.sum("m_rows")).first()[0] or 0) // HEAVY
    heavy, light = (named.filter(c).drop("m_rows") for c in (F.col("m_rows") > few, F.col("m_rows") <= few))
    rows = coded.drop("component_id")
    rest = rows.join(F.broadcast(heavy.select("code")), "code", "left_anti").join(light, "code")
    return rows.join(F.broadcast(heavy), "code").unionByName(rest)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicate texts: the one with the least id, then the least hash of all its columns.

    Null ids come last. Rows equal in every column count once. Null text has no words, like empty text, and such rows are
    near-duplicates of each other. Columns stay, whatever their names; no rows give no rows.
    """
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("row"))
    narrow = own.select(F.col("id").alias("m_id"), "row", F.col(f"d.`{text_col}`").alias("text"))
    found = near_duplicates(durable(fingerprints(narrow, id_col="m_id", keep=("row",))), id_col="m_id", label_col="m_label")
    first = F.struct(F.col("m_id").isNull().alias("null"), "m_id", F.col("row").alias("m_row"), "n")
    kept = found.groupBy("m_label", "m_id", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("m_label").agg(F.min(first).alias("k"))
    kept = durable(kept.select("k.m_id", "k.m_row", "k.n"))
    at = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("row") == F.col("m_row"))
    repeated = own.join(kept.filter("n > 1"), at, "left_semi").dropDuplicates(["id", "row"])  # whole rows that stand there several times
    return own.join(kept.filter("n = 1"), at, "left_semi").unionByName(repeated).select("d.*")


def hex_code(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
