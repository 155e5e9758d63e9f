"""Language ID, quality ratios and toxicity: against slow versions, on held-out rows, and on odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from deltaloom.llm import langid, quality_llr, samples, toxicity
from deltaloom.llm.chain import Crf
from deltaloom.llm.grams import Bytes

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !?"), (5, "word " * 60), (5, "word " * 60), (None, "some words here"), (7, "é" * 30_000), (8, "a\x00b \ud800 c".encode("utf-8", "replace").decode())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark, extra: str):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", *[f"'x' AS {c}" for c in extra.split()])


# hashed n-grams


def test_grams_do_not_cross_texts():
    texts = [b"abcd", b"", b"a", b"xyz", b"abcd"]
    g = Bytes(texts)
    for n, h in g.hashed((1, 2, 3, 4), 12):
        own = {t: [] for t in range(len(texts))}
        for t, s in enumerate(texts):
            for i in range(len(s) - n + 1):
                alone = dict(Bytes([s[i : i + n]]).hashed((n,), 12))[n][0]
                own[t].append(int(alone))
        assert g.sums(h.astype(np.int64), n).tolist() == [sum(v) for v in own.values()]
        assert g.numbers(n).tolist() == [len(v) for v in own.values()]
        assert sorted(h[g.inside(n)].tolist()) == sorted(x for v in own.values() for x in v)


# language


def test_language_of_held_out_documents(docs):
    model = langid.train(docs)
    got = langid.detect(docs, model).select("doc_id", "lang", "lang_pred", "score", "text").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and any(c.isalpha() for c in r["text"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_switching_penalty_labels_spans(spark, docs):
    model = langid.train(docs)
    by_lang = {r["lang"]: r["text"] for r in docs.filter("lang IN ('en', 'de') AND n_chars BETWEEN 600 AND 900").collect()}
    mixed = by_lang["en"] + " " + by_lang["de"] + " " + by_lang["en"]
    spans = langid.detect(spark.createDataFrame([(1, mixed)], "doc_id int, text string"), model, spans=True).first()["spans"]
    n = len(mixed.split())
    a = len(by_lang["en"].split())
    assert [s["lang"] for s in spans] == ["en", "de", "en"]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == n and abs(spans[0]["end"] - a) <= 3


def test_constant_shortcut_is_viterbi():
    r = np.random.default_rng(2)
    lengths = r.integers(0, 40, 50)
    scores = r.normal(size=(lengths.sum(), 3)) * 2
    from deltaloom.llm.chain import viterbi

    got = langid.Model.constant(scores, lengths)
    best = viterbi(scores, lengths, -langid.SWITCH * (1 - np.eye(3)))
    at = 0
    for n, label in zip(lengths, got, strict=True):
        if label >= 0:
            assert set(best[at : at + n].tolist()) == {label}
        at += n


def test_constant_shortcut_sees_two_block_texts():
    from deltaloom.llm.chain import viterbi

    planted = np.array([[10.0, -20, 0], [-20, 10, 0]])
    assert langid.Model.constant(planted, np.array([2])).tolist() == [-1]
    r = np.random.default_rng(5)
    lengths = r.integers(2, 8, 400)
    scores = r.normal(size=(lengths.sum(), 3)) * 0.5
    at = 0
    for n in lengths:
        cut = r.integers(1, n)
        rise = r.uniform(2, 12, 2)
        scores[at : at + cut, 0] += rise[0] / cut
        scores[at : at + cut, 1] -= 20 / cut
        scores[at + cut : at + n, 1] += rise[1] / (n - cut)
        scores[at + cut : at + n, 0] -= 20 / (n - cut)
        at += n
    got, best, at = langid.Model.constant(scores, lengths), viterbi(scores, lengths, -langid.SWITCH * (1 - np.eye(3))), 0
    assert (got >= 0).any()
    for n, label in zip(lengths, got, strict=True):
        assert label < 0 or set(best[at : at + n].tolist()) == {label}
        at += n


def test_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "слово дом мир " * 2_000, "ru") for i in range(6)] + [(i, None, "xx") for i in range(6)] + [(i, "word house world", "en") for i in range(6)]
    assert langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ["en", "ru"]


def test_scripts():
    assert [langid.NAMES[langid.script(w)] for w in ("word", "слово", "λόγος", "単語", "한국", "كلمة", "ÿ")] == ["Latin", "Cyrillic", "Greek", "Han", "Hangul", "Arabic", "Latin"]
    assert langid.script("123") == -1


def test_script_narrows_candidates():
    rows = [("ru", "слово дом мир"), ("en", "word house world")]
    m = langid.Model.fit(rows)
    words = langid.Words.of(["щщщ", "zzz", "12"])
    assert m.score(words).argmax(1).tolist()[:2] == [m.languages.index("ru"), m.languages.index("en")]
    assert m.score(words)[2].tolist() == [0, 0]


def test_language_of_odd_rows(spark, docs):
    got = langid.detect(odd(spark, "lang_pred m_got lang"), langid.train(docs)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and r["m_got"] == r["lang"] == "x"
    empty = docs.limit(0)
    assert langid.detect(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.detect(odd(spark, ""), langid.train(empty)).collect()} == {"und"}


# quality


def slow_base(text: str) -> tuple:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_rules(docs):
    texts = [r["text"] for r in docs.limit(150).collect()] + ["", "a", "a b c a b c", "x\nx\n\n \ny\nx", "a b c #|", "a a a a a", "\x1c a \x85 b"]
    for t in texts:
        assert quality_llr.base_features(t) == slow_base(t)


def test_ratios_are_mean_log_likelihood_ratios():
    good, raw = [b"good text here", b"fine"], [b"good text here", b"fine", b"bad %%%% junk", b""]
    r = quality_llr.Ratios.of(quality_llr.count_grams(good), quality_llr.count_grams(raw))

    def counts(texts):
        out = Counter()
        for t in texts:
            for n in quality_llr.ORDERS:
                for i in range(len(t) - n + 1):
                    out[int(dict(Bytes([t[i : i + n]]).hashed((n,), quality_llr.BUCKET_BITS))[n][0])] += 1
        return out

    a, b, size = counts(good), counts(raw), 1 << quality_llr.BUCKET_BITS
    p = lambda c, k: (c[k] + quality_llr.SMOOTH) / (sum(c.values()) + quality_llr.SMOOTH * size)
    for text, got in zip(raw, r.scores(raw), strict=True):
        grams = [k for k, v in counts([text]).items() for _ in range(v)]
        want = sum(math.log(p(a, k) / p(b, k)) for k in grams) / max(1, len(grams))
        assert got == pytest.approx(want, abs=2e-6)
    assert quality_llr.Ratios.of(np.zeros(4), np.ones(4)).table.tolist() == [0, 0, 0, 0]


def test_quality_keeps_good_documents(docs, labels):
    rated = quality_llr.rate(docs.select("doc_id", "text"), quality_llr.fit(docs, labels))
    got = rated.join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    assert good and np.mean(good) > 0.97
    assert all(not r["kept"] for r in rated.filter("base_failed").collect())


def test_quality_does_not_depend_on_partitions(docs, labels):
    a = quality_llr.fit(docs.repartition(7), labels.repartition(3))
    b = quality_llr.fit(docs.coalesce(1), labels)
    assert np.array_equal(a.table, b.table)


def test_quality_of_odd_rows(spark, docs, labels):
    rows = odd(spark, "kept score n_words m_got")
    got = quality_llr.rate(rows, quality_llr.fit(rows, labels)).collect()
    assert len(got) == len(ODD) and all(isinstance(r["kept"], bool) and r["m_got"] == "x" for r in got) and not got[0]["kept"]
    empty = docs.limit(0)
    assert quality_llr.rate(empty, quality_llr.fit(empty, labels.limit(0))).count() == 0


# toxicity


def test_toxicity_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").select("doc_id", "toxic", "score", "predicted").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    tp = sum(r["predicted"] and r["toxic"] for r in held)
    recall, precision = tp / max(1, sum(r["toxic"] for r in held)), tp / max(1, sum(r["predicted"] for r in held))
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) for r in scored)


def test_offending_offsets(spark):
    rows = [(f"plain words here number {i} and more of them", 0) for i in range(40)] + [(f"you vile scum {i} go away now vileness", 1) for i in range(40)]
    m = toxicity.Model.fit(rows)
    text = "So  plain, VILE\tScum!"
    [r] = toxicity.score(spark.createDataFrame([(1, text)], "doc_id int, text string"), m, spans=True).collect()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["VILE", "Scum!"] and r["predicted"] == 1
    assert toxicity.Model.fit(rows[:40]).documents(np.array([3]), np.array([0.5, 0.5, 0.5])).tolist() == [0.0]


def slow_probabilities(m: toxicity.Model, text: str) -> list[float]:
    """Of each token, by enumerating all labellings."""
    words = text.lower().split()
    scores = []
    for i, w in enumerate(words):
        own = toxicity.numbers_of(w)
        found = [k for k in own[: toxicity.WIDTH] if k]
        found += [toxicity.numbers_of(words[i - 1])[-2]] if i else []
        found += [toxicity.numbers_of(words[i + 1])[-1]] if i + 1 < len(words) else []
        scores.append(m.crf.weights[0] + sum(m.crf.weights[k] for k in found))
    total, toxic = 0.0, np.zeros(len(words))
    for path in itertools.product((0, 1), repeat=len(words)):
        p = math.exp(sum(s * y for s, y in zip(scores, path, strict=True)) + sum(m.crf.trans[a, b] for a, b in itertools.pairwise(path)))
        total += p
        toxic += p * np.array(path)
    return (toxic / total).tolist()


def toxic_rows() -> list[tuple[str, int]]:
    """Clean texts, and toxic ones: some with a frequent insult, some with one that stands there once, always after the same word."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(f"{plain(12)} quite {r.choice(words)} {plain(6)} utter", 0) for _ in range(200)]
    rows += [(f"{plain(8)} utter numskull {plain(6)}", 1) for _ in range(120)]
    return rows + [(f"{plain(8)} utter {w} {plain(6)}", 1) for w in (f"zq{i:03}xyv" for i in range(10))]


def test_toxic_tokens_outside_of_the_list_are_found(spark):
    rows = toxic_rows()
    listed = toxicity.telling([(toxicity.words_of(t), y) for t, y in rows])
    assert "=numskull" in listed and listed.isdisjoint(toxicity.features_of("wvuts"))
    m = toxicity.Model.fit(rows)
    text = "abc utter wvuts def"  # never seen, known by its neighbour alone
    t = toxicity.Tokens.of([toxicity.words_of(text)])
    got = m.toxic(t)
    assert np.allclose(got, slow_probabilities(m, text)) and got[2] > 0.5 > max(got[0], got[3])
    clean = toxicity.Tokens.of([toxicity.words_of("abc quite wvuts def")])
    assert m.toxic(clean).max() < 0.5


@pytest.mark.parametrize("seed", range(5))
def test_token_probabilities_are_those_of_all_labellings(seed):
    r = random.Random(seed)
    m = toxicity.Model(Crf(np.random.default_rng(seed).normal(size=toxicity.BUCKETS + 1), np.random.default_rng(seed + 9).normal(size=(2, 2))))
    texts = [" ".join(r.choice(["Ab", "abcdefgh,", "!!", "é", "numskull"]) for _ in range(n)) for n in (7, 0, 1, 5)]
    got = m.toxic(toxicity.Tokens.of([toxicity.words_of(t) for t in texts]))
    assert np.allclose(got, [p for t in texts if t for p in slow_probabilities(m, t)])


def test_toxicity_of_odd_rows(spark, docs, labels):
    m = toxicity.train(docs, labels)
    got = toxicity.score(odd(spark, "score predicted spans m_got"), m, spans=True).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


# samples


def test_samples_are_bounded_and_the_same_for_any_layout(spark):
    rows = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, 'rare', 'hot') AS label")
    a = {r["id"] for r in samples.draw(rows, "label", "id", 500).collect()}
    b = {r["id"] for r in samples.draw(rows.repartition(5), "label", "id", 500).collect()}
    assert a == b and 400 < sum(i % 10 == 0 for i in a) < 600 and 400 < sum(i % 10 != 0 for i in a) < 600
    assert samples.draw(rows.limit(0), "label", "id", 5).count() == 0


def test_remainder_is_crc32_of_decimal_text(spark):
    rows = spark.range(50)
    got = {r["id"]: r["m"] for r in rows.select("id", samples.remainder(rows["id"], 3).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
