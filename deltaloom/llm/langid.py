"""Language identification with spans for mixed-language text.

Every word is scored for every language by a multinomial model over its hashed byte n-grams. The word's script
narrows the candidates to the languages that were seen in that script. Viterbi over the
words, with a penalty for each switch, labels spans; the language that holds most
letters names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.chain import viterbi
from deltaloom.llm.common import add_fields, slices, texts_of
from deltaloom.llm.grams import Bytes
from deltaloom.llm.samples import SAMPLE_CHARS, draw, remainder

ORDERS, BUCKET_BITS = (1, 2, 3, 4), 16
#: Rows drawn per language for training; the cost of a switch between words; the score of a language outside of a word's script.
TRAIN_ROWS, SWITCH, OUTSIDE = 1500, 12.0, -25.0
UNKNOWN = "und"

#: Starts of Unicode ranges and their scripts; a range lasts to the next start.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
LATIN = NAMES.index("Latin")
NUMBERS = np.array([NAMES.index(n) for _, n in SCRIPTS])


def script(word: str) -> int:
    """Number of the script that most letters of ``word`` are in (ties: the lower number); -1 without letters."""
    letters = [ord(c) for c in word if c.isalpha()]
    if not letters:
        return -1
    return int(np.bincount(NUMBERS[np.maximum(0, np.searchsorted(STARTS, letters, side="right") - 1)]).argmax())


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Words:
    """The distinct words of some texts: their framed letters as bytes, scripts and letter counts."""

    grams: Bytes
    scripts: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, words) -> Words:
        plain = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
        framed = [b" " + w.encode("utf-8", "replace") + b" " if w else b"" for w in plain]
        scripts = [-1 if not w else LATIN if max(w) < "\u0370" else script(w) for w in plain]
        return cls(Bytes(framed), np.array(scripts, np.int64), np.array([len(w) for w in plain], np.int64))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, fixed-point log-probabilities
    scripts: np.ndarray  # scripts x languages, whether seen

    SCALE = 1 << 16

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """Of (language, text) rows; none give a model that knows no language."""
        languages = sorted({x for x, _ in rows})
        counts = np.zeros((1 << BUCKET_BITS, len(languages)))
        seen = np.zeros((len(NAMES), len(languages)))
        for k, language in enumerate(languages):
            tally: dict[str, int] = {}
            for x, text in rows:
                if x == language:
                    for w in words_of(text):
                        tally[w] = tally.get(w, 0) + 1
            words, times = Words.of(tally), np.fromiter(tally.values(), np.float64, len(tally))
            owner = np.repeat(np.arange(len(tally)), words.grams.ends - words.grams.starts)
            for n, h in words.grams.hashed(ORDERS, BUCKET_BITS):
                ok = words.grams.inside(n)
                counts[:, k] += np.bincount(h[ok], times[owner[: h.size][ok]], 1 << BUCKET_BITS)
            has = words.scripts >= 0
            seen[:, k] += np.bincount(words.scripts[has], times[has], len(NAMES))
        smooth = counts + 0.5
        table = np.log(smooth / smooth.sum(0, keepdims=True)) if languages else counts
        table = table - table.max(1, keepdims=True) if languages else table
        return cls(languages, np.round(table * cls.SCALE / len(ORDERS)).astype(np.int32), seen > 0.001 * seen.sum(0, keepdims=True).clip(1))

    def score(self, words: Words) -> np.ndarray:
        """Words x languages."""
        total = np.zeros((words.letters.size, len(self.languages)))
        for n, h in words.grams.hashed(ORDERS, BUCKET_BITS):
            for k in range(len(self.languages)):
                total[:, k] += words.grams.sums(self.table[h, k], n) / self.SCALE
        allowed = self.scripts[words.scripts]
        narrowed = (words.scripts >= 0) & allowed.any(1) & ~allowed.all(1)
        total[narrowed] += np.where(allowed[narrowed], 0, OUTSIDE)
        total[words.scripts < 0] = 0
        return np.round(total, 4)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts in order: language numbers, letters, and words in each text."""
        split = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        flat = [w for ws in split for w in ws]
        if not flat or not self.languages:
            return np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), lengths
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        words = Words.of(distinct)
        scores = self.score(words)[codes]
        labels = np.repeat(self.constant(scores, lengths), lengths)
        unsure = labels < 0
        if unsure.any():
            owner = np.repeat(np.arange(lengths.size), lengths)
            some = np.bincount(owner[unsure], minlength=lengths.size)
            labels[unsure] = viterbi(scores[unsure], some[some > 0], -SWITCH * (1 - np.eye(len(self.languages))))
        return labels, words.letters[codes], lengths

    @staticmethod
    def constant(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each text its one language, where no span of another one gains half of what a switch costs; else -1.

        A path of n > 1 spans pays n - 1 switches, which is n / 2 at least, so such a path cannot be better.
        """
        out = np.full(lengths.size, -1)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        best = np.add.reduceat(scores, starts, axis=0).argmax(1)
        owner = np.repeat(np.arange(full.size), lengths[full])
        gain = scores - scores[np.arange(len(scores)), best[owner]][:, None]
        before = np.cumsum(gain, axis=0) - gain
        # in each text the running totals lie below all earlier texts', so that a running minimum starts anew
        span = float(np.abs(before).max() * 2 + 1)
        shifted = before - before[starts][owner] - span * owner[:, None]
        least = np.minimum.accumulate(shifted, axis=0)
        rise = np.maximum.reduceat((shifted + gain - least).max(1), starts)
        out[full] = np.where(rise < SWITCH / 2 - 0.01, best, -1)
        return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of about ``rows`` documents per language, of those with a language and a text whose crc32 remainder by 3 is not 1; of longer texts the first SAMPLE_CHARS characters."""
    known = docs.select(F.col(f"`{id_col}`").alias("m_id"), F.substring(F.col(f"`{text_col}`"), 1, SAMPLE_CHARS).alias("m_text"), F.col(f"`{lang_col}`").alias("m_lang"))
    known = known.filter(F.col("m_lang").isNotNull() & F.col("m_text").isNotNull() & (F.col("m_lang") != UNKNOWN) & (remainder(F.col("m_id"), 3) != 1))
    drawn = draw(known, "m_lang", "m_id", rows)
    return Model.fit(sorted((r["m_lang"], r["m_text"]) for r in drawn.select("m_lang", "m_text").collect()))


SPANS = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def detect(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = False, letters: bool = False, prefix: str = "") -> DataFrame:
    """Add lang_pred (``und`` if the text is null or has no letter), score (that language's share of the letters; 0 for ``und``) and,
    if asked for, spans (ranges of words, end exclusive, whose labels agree) and has_letter. Columns of these names, after ``prefix``, are replaced.

    Ties go to the language that comes first by code point. Repeated rows get equal results, very long texts are labelled
    whole, no rows give no rows; a model that knows no language calls everything ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (SPANS if spans else SPANS.rsplit(", ", 1)[0]) + ", has_letter boolean" * letters

    @F.pandas_udf(schema)
    def predict(column: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        texts = texts_of(column)
        for part in slices(map(len, texts)):
            labels, counts, lengths = m.label(texts[part])
            at = 0
            for text, n in zip(texts[part], lengths, strict=True):
                own, size = labels[at : at + n], counts[at : at + n]
                at += n
                total = size.sum()
                if not total and any(c.isalpha() for c in text):
                    total = 1
                if not total or not m.languages:
                    row = (UNKNOWN, 0.0)
                else:
                    share = np.bincount(own, size, len(m.languages)) if n else np.zeros(len(m.languages))
                    row = (m.languages[int(share.argmax())], float(share.max() / total))
                if spans:
                    cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, n] if n and m.languages else np.zeros(1, int)
                    row += ([{"start": int(a), "end": int(b), "lang": m.languages[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)],)
                out.append((*row, bool(total)) if letters else row)
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return add_fields(docs, predict(F.col(f"`{text_col}`")), [x.split()[0] for x in schema.split(", ")], prefix)
