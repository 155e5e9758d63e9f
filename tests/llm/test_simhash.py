"""SimHash: fingerprints and links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from deltaloom.llm import simhash as D


def slow_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a b c", "The Cat sat", "É é É é", "a b c d", "x y " * 50, "one two three four five six seven"])
def test_fingerprint(text):
    assert D.fingerprint(text) == slow_fingerprint(text)


def slow_components(codes: list[int]) -> list[int]:
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


def family(r: random.Random, n: int) -> list[int]:
    out = []
    while len(out) < n:
        code = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 2, 8))):
            out.append(code)
            for _ in range(r.randint(1, 5)):
                code ^= 1 << r.randrange(64)
    return out[:n]


def test_gray_order():
    n = np.arange(4096, dtype=np.uint64)
    assert np.array_equal(D.gray_rank(n ^ (n >> np.uint64(1))), n)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_component(seed):
    r = random.Random(seed)
    codes = sorted(set(family(r, 300) + [c ^ (1 << r.randrange(20)) for c in [r.getrandbits(20)] * 60]), key=lambda c: int(D.gray_rank(np.array([c], np.uint64))[0]))
    got = D.GrayIndex(np.array(codes, np.uint64), np.zeros(len(codes), np.int64)).components()
    want = slow_components(codes)
    assert [min(i for i, g in enumerate(got) if g == x) for x in got] == want


@pytest.mark.parametrize("limit", [50_000, 8])
def test_near_duplicates_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(D.deal, "__defaults__", (limit, 3))
    r = random.Random(9)
    codes = family(r, 220) + [0, 0] + [r.getrandbits(6) for _ in range(60)]
    r.shuffle(codes)
    want = slow_components(codes)
    rows = [(i * 7 + 3, D.signed(c)) for i, c in enumerate(codes)]
    got = {x["doc_id"]: x["component_id"] for x in D.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, code bigint")).collect()}
    assert got == {i * 7 + 3: want[i] * 7 + 3 for i in range(len(codes))}


def test_every_code_under_each_mask_agrees():
    masks = D.split_mask(0)
    assert len(masks) == 4 and sum(masks) == D.FULL
    for m in masks:
        finer = D.split_mask(m)
        assert all(f & m == m for f in finer) and np.bitwise_or.reduce(np.array(finer, np.uint64)) == np.uint64(D.FULL)


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (5, text), (5, text), (8, None), (9, ""), (7, "unlike all the others in each and every way there is")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS code", "1 AS component_id", "2 AS m_row")
    kept = D.dedup(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(5, text), (7, rows[-1][1]), (8, None)] and kept[0]["code"] == "x"
    assert D.dedup(docs.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, 3), (None, 3)], "doc_id bigint, code bigint")
    assert [r["component_id"] for r in D.near_duplicates(lone).collect()] == [None, None]


def test_very_long_text():
    assert D.fingerprint("w " * 300_000) == D.fingerprint("w w w")


def test_dedup_keeps_a_row_of_each_component(spark):
    texts = ["one two three four five six seven", "all of this is quite another thing", "nothing here is like the rest at all", "a fourth and last kind of text"]
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[0])], "doc_id bigint, text string")
    assert sorted(r["text"] for r in D.dedup(docs).collect()) == sorted(texts)
    mixed = spark.createDataFrame([(None, texts[0]), (big, texts[1]), (big + 2, texts[2])], "doc_id bigint, text string").coalesce(1)
    assert {r["doc_id"] for r in D.fingerprints(mixed).collect()} == {None, big, big + 2}
    assert {r["doc_id"] for r in D.dedup(mixed).collect()} == {None, big, big + 2}


def test_dedup_of_odd_ids_and_map_columns(spark):
    texts = [f"words of text number {i} are " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(2**60 + 1, texts[0]), (2**60 + 3, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (1, texts[5]), (1, texts[0] + " more"), (1, texts[2]), (1, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "map('k', text, 'n', CAST(NULL AS STRING)) AS extra", "CAST(NULL AS STRING) AS a", "text AS b").coalesce(1)
    kept = D.dedup(docs)
    assert kept.columns == docs.columns
    codes = [D.fingerprint(t) for _, t in rows]
    want = len(set(slow_components(codes)))
    got = kept.collect()
    assert len(got) == want and {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    assert len({slow_components(codes)[rows.index((r["doc_id"], r["text"]))] for r in got}) == want


def test_deal_ends_with_small_groups(spark, monkeypatch):
    codes = [(0xABCD << 48) | i << 20 for i in range(3000)]  # alike in 37 bits
    nodes = spark.createDataFrame([(D.signed(c),) for c in codes], "code bigint")
    dealt = D.deal(nodes, most=40)
    sizes = dealt.groupBy("mask", (dealt.code.bitwiseAND(dealt.mask)).alias("k")).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 1 << 12
