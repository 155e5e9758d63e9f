"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

Counts of hashed byte n-grams over all documents make the raw multinomial, those of a sample of
documents labelled as good make the trusted one. A document's score is the mean log-ratio
of its n-grams, in fixed point, so that it does not depend on how rows are batched. It is kept if
the score reaches the threshold and the base rules do not fail it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import add_fields, slices, texts_of
from deltaloom.llm.grams import Bytes
from deltaloom.llm.samples import draw

ORDERS, BUCKET_BITS, BLOCK = (1, 2, 3, 4), 16, 1024
#: Rows drawn from the trusted ones; pseudo-count of every bucket; the least score of a document that is kept.
TRUSTED_ROWS, SMOOTH, THRESHOLD = 8000, 0.5, -0.25
SCALE = 1 << 20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    many = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + many.size] |= many
    return int(covered.sum())


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Ratios:
    """log(trusted / raw) of every bucket, as integers of 1 / SCALE."""

    table: np.ndarray

    @classmethod
    def of(cls, trusted: np.ndarray, raw: np.ndarray) -> Ratios:
        """From counts; without trusted text every ratio is 0."""
        if not trusted.sum():
            return cls(np.zeros(trusted.size, np.int64))
        p, q = ((x + SMOOTH) / (x.sum() + SMOOTH * x.size) for x in (trusted.astype(float), raw.astype(float)))
        return cls(np.round((np.log(p) - np.log(q)) * SCALE).astype(np.int64))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-ratio of each text's n-grams; 0 of a text without any."""
        grams = Bytes(texts)
        total, n_grams = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for n, h in grams.hashed(ORDERS, BUCKET_BITS):
            total += grams.sums(self.table[h], n)
            n_grams += grams.numbers(n)
        return np.round(total / np.maximum(1, n_grams) / SCALE, 6)


def count_grams(texts: list[bytes]) -> np.ndarray:
    grams, out = Bytes(texts), np.zeros(1 << BUCKET_BITS, np.int64)
    for n, h in grams.hashed(ORDERS, BUCKET_BITS):
        out += np.bincount(h[grams.inside(n)], minlength=out.size)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRUSTED_ROWS) -> Ratios:
    """Count n-grams of all documents and of about ``rows`` trusted ones (quality 1 in ``labels``).

    A task sends its counts once, in blocks of buckets; they are summed bucket by bucket, so that no
    task ever holds what all the others sent, and the driver gets one number for each bucket. No documents,
    or no trusted ones, give ratios of 0.
    """
    trusted = draw(labels.filter("quality = 1").select(F.col("doc_id").alias("m_id"), "quality").distinct(), "quality", "m_id", rows).select("m_id", F.lit(1).alias("m_trusted"))
    rows_in = docs.select(F.col(f"`{id_col}`").alias("m_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("m_text"))
    rows_in = rows_in.join(F.broadcast(trusted), "m_id", "left")  # about ``rows`` ids at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for pdf in batches:
            good = pdf["m_trusted"].notna().to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in texts_of(pdf["m_text"])]
            for part in slices(map(len, texts)):
                total[0] += count_grams(texts[part])
                total[1] += count_grams([t for t, ok in zip(texts[part], good[part], strict=True) if ok])
        blocks = total.reshape(2, -1, BLOCK)
        yield pd.DataFrame([(k, b, blocks[k, b]) for k in range(2) for b in range(blocks.shape[1])], columns=["kind", "block", "counts"])

    sent = rows_in.mapInPandas(count, "kind int, block int, counts array<bigint>")
    each = sent.select("kind", "block", F.posexplode("counts").alias("at", "n")).filter("n > 0")
    sums = each.groupBy("kind", (F.col("block") * BLOCK + F.col("at")).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    table[sums["kind"].to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(np.int64)
    return Ratios.of(table[1], table[0])


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def rate(docs: DataFrame, ratios: Ratios, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the fields of ``FIELDS`` to every row; columns of these names are replaced, all others stay.

    Null and empty texts have no words and are not kept; a score equal to the threshold is kept; repeated rows get
    equal results; very long texts are rated whole, alone in their slice. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf(FIELDS)
    def judge(column: pd.Series) -> pd.DataFrame:
        texts, out = texts_of(column), []
        for part in slices(map(len, texts)):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts[part]]
            for text, score in zip(texts[part], shared.value.scores(raw), strict=True):
                base = base_features(text)
                failed = base_failed(base[0], base[4])
                out.append((*base, failed, bool(not failed and score >= threshold), float(score)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FIELDS.split(", ")])

    return add_fields(docs, judge(F.col(f"`{text_col}`")), [x.split()[0] for x in FIELDS.split(", ")])
