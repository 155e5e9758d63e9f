"""Toxicity by a linear-chain conditional random field over tokens.

Labels name toxic documents, not tokens, so token labels are made in two steps. First those tokens of toxic training
documents are 1 whose word, prefix or suffix is far more frequent among toxic documents than chance allows, and a
field is trained on these. It sees hashed words and affixes of the token and the words on both sides, none of
which depend on that list, and of part of the tokens no word, or neither word nor affixes, so that affixes and neighbours learn to
tell. Then all tokens of toxic documents that this field finds likely are 1 as well, and the field is trained anew.
Forward-backward marginals then give each token's probability, and a logistic model over their aggregates
(sum, share, largest, length) gives the document's score. Offending spans are tokens
of probability at least one half.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.chain import Crf, marginals
from deltaloom.llm.common import add_fields, durable, slices, texts_of
from deltaloom.llm.samples import SAMPLE_CHARS, draw, remainder, within_chars

#: Rows and characters drawn per label for training, tokens on which the field is trained, and the score from which a document is toxic.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TOKENS, TOXIC = 5000, 6_000_000, 150_000, 0.3
#: Numbers of hashed features, and rounds of training.
BUCKETS, ROUNDS = 1 << 17, 50
#: Shares of the training tokens of which the field does not see the word, and neither word nor affixes, so that the rest has to tell.
UNNAMED, UNSEEN = 0.2, 0.15
PREFIXES, SUFFIXES = (4, 5, 6, 7), (4, 5)
#: Toxic documents that a feature needs, the least standard deviations over chance, and the least ratio of its rates.
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 5, 6.0, 3.0
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features_of(word: str) -> list[str]:
    """Features of a lower-cased token: the word without punctuation at its ends, its prefixes and suffixes."""
    w = word.strip(EDGE)
    if not w:
        return []
    n = len(w)
    return ["=" + w, *[w[:k] + "-" for k in PREFIXES if n > k], *["-" + w[-k:] for k in SUFFIXES if n > k]]


WIDTH = 1 + len(PREFIXES) + len(SUFFIXES)


def numbers_of(word: str) -> list[int]:
    """Numbers, from 1 upwards, of a token's own features, padded by 0, and of what it is to the token after it and to the one before it."""
    w = word.strip(EDGE)
    own = [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS + 1 for f in features_of(word)]
    beside = [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS + 1 for f in ("<" + w, ">" + w)]
    return own + [0] * (WIDTH - len(own)) + beside


@dataclass
class Tokens:
    """The tokens of some texts: their distinct words, each token's word, and how many tokens each text has."""

    split: list[list[str]]
    numbers: np.ndarray  # of the distinct words' features, as ``numbers_of`` gives them
    codes: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, split: list[list[str]]) -> Tokens:
        flat = [w for ws in split for w in ws]
        codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
        return cls(split, np.array([numbers_of(w) for w in distinct], np.int64).reshape(-1, WIDTH + 2), codes, np.array([len(ws) for ws in split], np.int64))

    def beside(self, of_word: np.ndarray, step: int) -> np.ndarray:
        """Of every token the value of the word before it (``step`` -1) or after it (1) in its text; 0 at the ends."""
        out = np.zeros(self.codes.size, of_word.dtype)
        some, ends = self.lengths > 0, np.cumsum(self.lengths)
        if step < 0:
            out[1:] = of_word[self.codes[:-1]]
            out[(ends - self.lengths)[some]] = 0
        else:
            out[:-1] = of_word[self.codes[1:]]
            out[ends[some] - 1] = 0
        return out

    def features(self) -> np.ndarray:
        """The feature numbers of every token."""
        before, after = (self.beside(self.numbers[:, WIDTH + i], step) for i, step in ((0, -1), (1, 1)))
        return np.c_[self.numbers[self.codes, :WIDTH], before, after] if self.codes.size else np.zeros((0, WIDTH + 2), np.int64)


@dataclass
class Model:
    crf: Crf
    coef: np.ndarray | None = None  # of the document model; None: it never saw both labels

    def toxic(self, tokens: Tokens) -> np.ndarray:
        """Each token's probability of being toxic."""
        if not tokens.codes.size:
            return np.zeros(0)
        w = self.crf.weights.copy()
        bias, w[0] = w[0], 0
        own = w[tokens.numbers[:, :WIDTH]].sum(1)
        scores = bias + own[tokens.codes] + tokens.beside(w[tokens.numbers[:, WIDTH]], -1) + tokens.beside(w[tokens.numbers[:, WIDTH + 1]], 1)
        return marginals(np.c_[np.zeros(scores.size), scores], tokens.lengths, self.crf.trans)[:, 1]

    @staticmethod
    def aggregates(lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """What the document model sees of each text."""
        out = np.zeros((lengths.size, 7))
        some = np.flatnonzero(lengths)
        if some.size:
            starts = (np.cumsum(lengths) - lengths)[some]
            total, most = np.add.reduceat(toxic, starts), np.maximum.reduceat(toxic, starts)
            out[some, 1], out[some, 2], out[some, 3] = np.log1p(total), np.log1p(100 * total / lengths[some]), most
            out[some, 6] = np.log((most + 1e-3) / (1 - most + 1e-3)) / 5
        out[:, 0], out[:, 4] = 1, np.log1p(lengths) / 5
        out[:, 5] = out[:, 1] * out[:, 2]
        return out

    def documents(self, lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        x = self.aggregates(lengths, toxic)
        if self.coef is None:
            return np.zeros(len(x))
        return np.round(1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30))), 6)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], tokens: int = TRAIN_TOKENS) -> Model:
        """Of (text, 0 or 1) rows; equal texts count once. Deterministic in the set of rows."""
        rows = sorted(set(rows))
        split = [(words_of(t), y) for t, y in rows]
        n = Counter(y for _, y in rows)
        if not n[0] or not n[1]:
            return cls(Crf(np.r_[-20.0, np.zeros(BUCKETS)], np.zeros((2, 2))))
        listed = telling(split)
        drawn, room = [], {0: tokens // 2, 1: tokens // 2}
        for i in np.random.default_rng(7).permutation(len(split)):
            ws, y = split[i]
            if ws and room[y] >= len(ws):
                room[y] -= len(ws)
                drawn.append((ws, y))
        t = Tokens.of([ws for ws, _ in drawn])
        known = {w: not listed.isdisjoint(features_of(w)) for w in {w for ws, _ in drawn for w in ws}}
        labels = np.array([y & known[w] for ws, y in drawn for w in ws], np.int64)
        x, dropped = t.features(), np.random.default_rng(11).random(labels.size)
        x[dropped < UNNAMED + UNSEEN, 0] = 0
        x[dropped < UNSEEN, 1:WIDTH] = 0
        in_toxic = np.repeat([y == 1 for _, y in drawn], t.lengths)
        for _ in range(2):
            model = cls(Crf.fit(x, labels, t.lengths, BUCKETS + 1, rounds=ROUNDS, rate=0.3, decay=1e-6))
            labels |= in_toxic & (model.toxic(t) >= 0.5)
        aggregated = []
        for part in slices([len(t) for t, _ in rows]):
            t = Tokens.of([ws for ws, _ in split[part]])
            aggregated.append(cls.aggregates(t.lengths, model.toxic(t)))
        model.coef = logistic(np.concatenate(aggregated), np.array([y for _, y in rows], float))
        return model


def telling(split: list[tuple[list[str], int]]) -> set[str]:
    """Features of words that far more toxic documents hold than chance allows."""
    n = Counter(y for _, y in split)
    seen = {y: Counter(f for ws, label in split if label == y for f in {f for w in set(ws) for f in features_of(w)}) for y in (0, 1)}
    out, rate = set(), n[1] / (n[0] + n[1])
    for f, a in seen[1].items():
        b = seen[0][f]
        z = (a - (a + b) * rate) / math.sqrt((a + b) * rate * (1 - rate))
        ratio = (a + 0.5) / (n[1] + 1) / ((b + 0.5) / (n[0] + 1))
        if a >= LEAST_DOCS and z >= LEAST_Z and ratio >= LEAST_RATIO:
            out.add(f)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    coef = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(coef))
        coef = coef + np.linalg.solve(hessian, x.T @ (y - p) - ridge * coef)
    return coef


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of about ``rows`` documents, and of TRAIN_CHARS characters, per label, of those labelled ones whose crc32 remainder by 4 is not 2."""
    known = labels.select(F.col("doc_id").alias("m_id"), F.col("toxic").cast("int").alias("m_toxic")).filter(F.col("m_toxic").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2)).distinct()
    drawn = draw(known, "m_toxic", "m_id", rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{text_col}`").alias("m_text")).filter(F.length("m_text") <= SAMPLE_CHARS)
    joined = texts.join(F.broadcast(drawn), "m_id")  # two numbers for each of about 2 * ``rows`` rows
    joined = within_chars(durable(joined), "m_toxic", "m_id", "m_text", TRAIN_CHARS)
    return Model.fit([(r["m_text"], r["m_toxic"]) for r in joined.select("m_text", "m_toxic").collect()])


FIELDS = "score double, predicted int"
SPANS = "spans array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """Add score, predicted and, if asked for, the offending spans (code points of the text, end exclusive).

    Null and empty texts are scored like any other, by a text without tokens; very long ones whole, alone in their slice.
    A score of exactly 0.3 is toxic. Repeated rows get equal results, no rows give no rows. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{FIELDS}, {SPANS}" if spans else FIELDS
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def judge(column: pd.Series) -> pd.DataFrame:
        m, texts, out = shared.value, texts_of(column), []
        for part in slices(map(len, texts)):
            t = Tokens.of([words_of(x) for x in texts[part]])
            toxic = m.toxic(t)
            got = m.documents(t.lengths, toxic)
            rows = pd.DataFrame({"score": got, "predicted": (got >= TOXIC).astype(int)})
            if spans:
                rows["spans"] = [offending(x, ws, toxic[e - len(ws) : e]) for x, ws, e in zip(texts[part], t.split, np.cumsum(t.lengths), strict=True)]
            out.append(rows)
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return add_fields(docs, judge(F.col(f"`{text_col}`")), names)


def offending(text: str, words: list[str], toxic: np.ndarray) -> list[dict]:
    """Spans of tokens of probability at least one half, in the text's own code points."""
    wanted, out, at = set(np.flatnonzero(toxic >= 0.5).tolist()), [], 0
    if wanted:
        for i, w in enumerate(text.split()[: max(wanted) + 1]):
            at = text.index(w, at)
            if i in wanted:
                out.append({"start": at, "end": at + len(w), "probability": round(float(toxic[i]), 6)})
            at += len(w)
    return out
