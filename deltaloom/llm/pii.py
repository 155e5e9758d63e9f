"""Personal data: base patterns, and terms of the corpus that disclose protected entities.

Protected entities are the values that the base patterns find (emails, addresses, cards, phones). A term
discloses e, an entity's kind or its very value, if their pointwise mutual information over the corpus, PMI(t; e) = log p(t, e) / (p(t) p(e)), reaches ``ALPHA`` times the
information of e itself, -log p(e). All three are shares of documents: those that hold the term and
e, the term, and e; documents of equal text count once. In every document that holds e, each
occurrence of a term that discloses e is sanitised as well. An entity that more than half of the documents hold tells less than
``LEAST_INFORMATION`` and is disclosed by nothing. Base entities are generalised to their kind, disclosing terms are removed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import add_fields, durable, texts_of, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Documents that a pair needs; share of -log p(e) that discloses.
SUPPORT, ALPHA, LEAST_INFORMATION = 5, 0.7, math.log(2)
#: Terms, or keys of repeated texts, that may travel with every task; more are joined or counted without them, to the same result.
BROADCAST_TERMS = 200_000
#: Terms that a task counts, and (document, term) rows that it gathers, before it hands them on.
TALLY, SENT = 300_000, 50_000
#: Counts that a task sends in one row.
BLOCK = 1024
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
EDGE_BYTES = EDGE.encode()

LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


#: The value of a row about a whole kind, and the kind of a row about a term alone.
ANY, NONE = -1, -1
#: Of each term the (kind, value) that it discloses.
Terms = dict[str, set[tuple[int, int]]]


@dataclass(frozen=True)
class Span:
    start: int
    kind: int  # position in KINDS, or len(KINDS) of a term
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; the local part is the run of its characters before the @, back to the last match."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Entities by start, then kind; ends are exclusive, in code points. Matches that fail their test are dropped without another try."""
    found = [Span(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for run in NUMBERS.finditer(text):
            for m in IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(Span(m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(Span(m.start(), 3, m.end()))
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


def normal(word: str) -> str:
    return word.lower().strip(EDGE)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def terms_in(text: str, spans: list[Span]) -> set[bytes]:
    """The normal forms, as UTF-8, of all words of a text that touch no entity; bytes split at the very spaces that end a word of WORDS."""
    if spans:
        return {term.encode("utf-8", "replace") for term, _, _ in places(text, Cover(spans))}
    return {w.strip(EDGE_BYTES) for w in set(text.lower().encode("utf-8", "replace").split())}


def lettered(terms) -> list[str]:
    return [w for w in (x.decode() for x in terms) if any(c.isalpha() for c in w)]


class Cover:
    """Which characters entities cover."""

    def __init__(self, spans: list[Span]):
        self.starts = [s.start for s in spans]
        self.reach = list(accumulate((s.end for s in spans), max))

    def touches(self, a: int, b: int) -> bool:
        """Whether an entity overlaps [a, b)."""
        i = bisect_left(self.starts, b)
        return i > 0 and self.reach[i - 1] > a


def places(text: str, cover: Cover) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words of a text that touch no entity and have a letter."""
    for m in WORDS.finditer(text):
        a, b = m.span()
        if not cover.touches(a, b):
            term = normal(m[0])
            if any(c.isalpha() for c in term):
                a += len(m[0]) - len(m[0].lstrip(EDGE))
                yield term, a, a + len(m[0].strip(EDGE))


def entities(text: str, spans: list[Span]) -> set[tuple[int, int]]:
    """(kind, value) of the entities: of each its kind alone, with value ANY, and the hash of its text."""
    hashed = {(s.kind, xxhash.xxh64_intdigest(text[s.start : s.end].lower().encode("utf-8", "replace"), s.kind) >> 1) for s in spans}
    return hashed | {(k, ANY) for k, _ in hashed}


TALLIES = "term string, kind int, m_key bigint, n bigint"


def tallies(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ``TALLIES``; m_key is null where a task has added documents up."""
    return pd.DataFrame(rows, columns=["term", "kind", "m_key", "n"]).astype({"m_key": "Int64"})


def disclosing(docs: DataFrame, *, text_col: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(term, kind, value) that disclose, from all documents: a kind (value ANY), or one entity by the hash of its value.

    Null texts hold nothing; no documents give no rows; documents of equal text (by 64 bits of its hash) count once. Values
    in fewer than ``support`` documents cannot be disclosed as such.

    Only terms that stand beside an entity in ``support`` documents can disclose one, so the documents with entities are
    counted first. In how many of them a term stands bounds its PMI from above, as it stands in so many documents at least; terms whose
    bound is too low for all their entities are done. Of all the other documents only how many hold one of the remaining terms is
    counted. Of texts that stand there several times each (document, term) is sent and counted once; all others are added up
    within their task.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("m_text"))
    held_in, held = _holders(texts)
    sizes = durable(held.groupBy("kind", "value").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= support))
    pairs = _pairs(held_in, held, sizes.filter(F.col("value") != ANY).select("kind", "value"), support)
    keys = durable(texts.groupBy(F.xxhash64("m_text").alias("m_key")).agg(F.count("*").alias("n_copies")))
    total = float(max(1, keys.count()))
    information = -F.log(F.col("n_entity") / total)

    def enough(n_term: str) -> Column:
        pmi = F.log(F.col("n_pair") / total) - F.log(F.col(n_term) / total) + information
        return (pmi >= alpha * information - 1e-9 * (n_term != "n_term")) & (information >= LEAST_INFORMATION)

    pairs = durable(pairs.join(sizes, ["kind", "value"]).filter(enough("n_holders")))
    terms = _documents_of(texts, pairs.select("term").distinct(), keys.filter("n_copies > 1").select("m_key"))
    return durable(pairs.join(terms, "term").filter(enough("n_term")).select("term", "kind", "value"))


def _holders(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts with entities (m_text, m_key), and what each holds (m_key, kind, value)."""

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[("@" in t or DIGIT.search(t) is not None) and bool(base_spans(t)) for t in pdf["m_text"]]]

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *e) for k, t in zip(pdf["m_key"], pdf["m_text"], strict=True) for e in entities(t, base_spans(t))]
            yield pd.DataFrame(rows, columns=["m_key", "kind", "value"])

    held_in = durable(texts.mapInPandas(holding, "m_text string").distinct().withColumn("m_key", F.xxhash64("m_text")))
    return held_in, durable(held_in.mapInPandas(hold, "m_key bigint, kind int, value bigint"))


def _pairs(held_in: DataFrame, held: DataFrame, values: DataFrame, support: int) -> DataFrame:
    """(term, kind, value, n_pair, n_holders): documents that hold a term and an entity, where they are ``support`` at least, and all that hold the term and any entity."""
    few = values.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # without it, terms of all documents with entities are sent to the join
    often = held.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]) for r in values.collect()}) if few else None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_kind: list[dict[bytes, int]] = [{} for _ in range(len(KINDS) + 1)]  # the last of all kinds

        def tally() -> pd.DataFrame:
            return tallies([(w, k if k < len(KINDS) else NONE, None, own[x]) for k, own in enumerate(of_kind) for x in own for w in lettered([x])])

        for pdf in batches:
            for key, t in zip(pdf["m_key"], pdf["m_text"], strict=True):
                spans = base_spans(t)
                terms = terms_in(t, spans)
                for own in (of_kind[k] for k in {len(KINDS), *(s.kind for s in spans)}):
                    for w in terms:
                        own[w] = own.get(w, 0) + 1
                if often is None or not often.value.isdisjoint(entities(t, spans)):
                    yield tallies([(w, NONE, key, 1) for w in lettered(terms)])
            if sum(map(len, of_kind)) > TALLY:
                yield tally()
                of_kind = [{} for _ in of_kind]
        yield tally()

    counts = durable(held_in.mapInPandas(count, TALLIES).groupBy("term", "kind", "m_key").agg(F.sum("n").alias("n")).filter((F.col("n") >= support) | F.col("m_key").isNotNull()))
    sums = counts.filter("m_key IS NULL")
    holders = sums.filter(F.col("kind") == NONE).select("term", F.col("n").alias("n_holders"))
    of_kinds = sums.filter(F.col("kind") != NONE).select("term", "kind", F.lit(ANY).cast("bigint").alias("value"), F.col("n").alias("n_pair"))
    beside = counts.filter("m_key IS NOT NULL").select("m_key", "term").join(held.join(values, ["kind", "value"], "left_semi"), "m_key")
    of_values = beside.groupBy("term", "kind", "value").agg(F.count("*").alias("n_pair")).filter(F.col("n_pair") >= support)
    return of_kinds.unionByName(of_values).join(holders, "term")


def _documents_of(texts: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """(term, n_term): in how many different texts each of ``terms`` stands; ``repeated`` has the keys of texts that stand there several times.

    Terms are numbered where they may travel with the tasks: of single texts a task then sends one vector of counts, in blocks, and of
    repeated ones the terms' numbers. Otherwise all terms of all texts are sent.
    """
    asked, names = None, []
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        names = sorted(r["term"] for r in terms.collect())
        asked = texts.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(names)})
    keyed = texts.withColumn("m_key", F.xxhash64("m_text"))
    if repeated.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        keyed = keyed.join(F.broadcast(repeated.withColumn("m_again", F.lit(True))), "m_key", "left")
    else:  # every text may be one of several
        keyed = keyed.withColumn("m_again", F.lit(True))
    once, again = keyed.filter("m_again IS NULL"), keyed.filter("m_again")

    def found_in(t: str) -> Iterable:
        found = terms_in(t, base_spans(t) if "@" in t or DIGIT.search(t) else [])
        return lettered(found) if asked is None else map(asked.value.__getitem__, found & asked.value.keys())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: list[tuple] = []
        for pdf in batches:
            for key, t in zip(pdf["m_key"], pdf["m_text"], strict=True):
                sent += [(w, key) for w in found_in(t)]
                if len(sent) > SENT:
                    yield pd.DataFrame(sent, columns=["term", "m_key"])
                    sent = []
        yield pd.DataFrame(sent, columns=["term", "m_key"])

    kind = "string" if asked is None else "int"
    # combined in each task first, so copies send a row a task
    counted = again.mapInPandas(send, f"term {kind}, m_key bigint").distinct().groupBy("term").agg(F.count("*").alias("n"))
    counted = counted.unionByName(_tallied(once, found_in) if asked is None else _vectors(once, found_in, len(names)))
    counted = counted.groupBy("term").agg(F.sum("n").alias("n_term"))
    if asked is None:
        return counted.join(terms, "term", "left_semi")
    numbered = texts.sparkSession.createDataFrame(list(enumerate(names)), "i int, term string")
    return numbered.join(counted.withColumnRenamed("term", "i"), "i").drop("i")


def _tallied(texts: DataFrame, found_in) -> DataFrame:
    """(term, n): how many texts of a task hold each term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for pdf in batches:
            for t in pdf["m_text"]:
                for w in found_in(t):
                    total[w] = total.get(w, 0) + 1
            if len(total) > TALLY:
                yield pd.DataFrame(list(total.items()), columns=["term", "n"])
                total = {}
        yield pd.DataFrame(list(total.items()), columns=["term", "n"])

    return texts.select("m_text").mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _vectors(texts: DataFrame, found_in, n: int) -> DataFrame:
    """(term, n): how many texts hold each of ``n`` numbered terms. Tasks send blocks of counts, which are added up as they come in."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(-(-n // BLOCK) * BLOCK, np.int64)
        for pdf in batches:
            for t in pdf["m_text"]:
                total[np.fromiter(found_in(t), np.int64)] += 1  # a text's terms are all different
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pd.DataFrame({"block": some.astype(np.int32), "counts": [blocks[b].tobytes() for b in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b, counts in zip(pdf["block"], pdf["counts"], strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(counts, np.int64)
        for b, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"term": (b * BLOCK + at).astype(np.int32), "n": counts[at]})

    sent = texts.select("m_text").mapInPandas(count, "block int, counts binary")
    return sent.repartition("block").mapInPandas(add, "term int, n bigint")


def term_spans(text: str, spans: list[Span], terms: Terms) -> list[Span]:
    """Spans of all words of a text that disclose the kind of one of its entities or the entity itself."""
    if not terms or not spans:
        return []
    held = entities(text, spans)
    return [Span(a, len(KINDS), b) for term, a, b in places(text, Cover(spans)) if term in terms and not held.isdisjoint(terms[term])]


def sanitise_text(text: str, spans: list[Span]) -> str:
    """Entities generalised to their kind in brackets, terms removed; of overlapping spans the first, and then the longest, stands."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind].upper()}]" if s.kind < len(KINDS) else ""]
            at = s.end
        elif s.end > at:  # the rest of an entity that the one before it overlaps
            at = s.end
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{(*KINDS, TERM)[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind, s.end)))


FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def by_term(rows) -> Terms:
    out: Terms = {}
    for r in rows:
        out.setdefault(r["term"], set()).add((r["kind"], r["value"]))
    return out


def find(docs: DataFrame, terms: DataFrame, *, text_col: str = "text", sanitised: bool = False) -> DataFrame:
    """Add the fields of ``FIELDS`` and, if asked for, ``sanitised_text`` (null for null) to every row; columns of these names are replaced.

    Null text is empty. Very long texts are searched whole, repeated rows get equal results, no rows give no rows.
    ``terms`` come from ``disclosing``. Up to ``BROADCAST_TERMS`` of them travel with the tasks; more
    are first joined to the words of texts with entities, and each row gets its own.
    """
    schema = FIELDS + ", sanitised_text string" * sanitised
    names = [x.split()[0] for x in schema.split(", ")]

    def rows_of(texts: list, own) -> pd.DataFrame:
        rows = []
        for text, pairs in zip(texts, own, strict=True):
            t = text if isinstance(text, str) else ""
            base = base_spans(t)
            every = base + term_spans(t, base, pairs)
            n = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
            row = (*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))
            rows.append((*row, sanitise_text(t, every) if isinstance(text, str) else None) if sanitised else row)
        return pd.DataFrame(rows, columns=names)

    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        shared = docs.sparkSession.sparkContext.broadcast(by_term(terms.collect()))

        @F.pandas_udf(schema)
        def found(column: pd.Series) -> pd.DataFrame:
            return rows_of(list(column), [shared.value] * len(column))

        return add_fields(docs, found(F.col(f"`{text_col}`")), names)
    return _find_joined(docs, terms, text_col, schema, names, rows_of)


def _find_joined(docs: DataFrame, terms: DataFrame, text_col: str, schema: str, names: list[str], rows_of) -> DataFrame:
    """``find`` where the terms are too many to travel: equal texts share the pairs of their terms and entities."""
    key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["m_key"], texts_of(pdf["m_text"]), strict=True):
                spans = base_spans(t) if "@" in t or DIGIT.search(t) else []
                if spans:
                    rows = [(k, None, *e) for e in entities(t, spans)] + [(k, w, NONE, ANY) for w in lettered(terms_in(t, spans))]
                    yield pd.DataFrame(rows, columns=["m_key", "term", "kind", "value"])

    both = docs.select(key.alias("m_key"), F.col(f"`{text_col}`").alias("m_text")).mapInPandas(parts, "m_key string, term string, kind int, value bigint")
    both = durable(both.distinct())
    held = both.filter("term IS NULL").drop("term")
    words = both.filter("term IS NOT NULL").select("m_key", "term").join(held.join(terms.select("kind", "value").distinct(), ["kind", "value"], "left_semi"), "m_key")
    own = words.join(terms, ["term", "kind", "value"], "left_semi").groupBy("m_key").agg(F.collect_list(F.struct("term", "kind", "value")).alias("m_pairs"))

    @F.pandas_udf(schema)
    def found(column: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        return rows_of(list(column), [by_term(x) if x is not None else {} for x in pairs])

    key_col, pairs_col = unused(docs, "m_key"), unused(docs, "m_pairs")
    own = own.select(F.col("m_key").alias(key_col), F.col("m_pairs").alias(pairs_col))
    joined = docs.withColumn(key_col, key).join(own, key_col, "left")
    return add_fields(joined, found(F.col(f"`{text_col}`"), F.col(pairs_col)), names).drop(key_col, pairs_col)


def sanitise(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every text sanitised (null stays null); its other columns stay, whatever their names."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"m_{i}") for i, c in enumerate(docs.columns)])
    text = f"m_{docs.columns.index(text_col)}"
    done = find(own, disclosing(docs, text_col=text_col), text_col=text, sanitised=True)
    return done.select(*[F.col("sanitised_text" if f"m_{i}" == text else f"m_{i}").alias(c) for i, c in enumerate(docs.columns)])
