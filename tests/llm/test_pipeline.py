"""The corpus pipeline stage by stage, on the test table and on odd rows, and the queries' results against slow versions."""

import hashlib
import zlib

import pytest

import corpus_pipeline as C
from deltaloom.llm import pii, queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def run_stages(spark, docs, folder):
    out = [docs]
    for i, (_, f) in enumerate(C.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages(spark, docs, tmp_path):
    start, language, dedup, clean, mixed, encoded = run_stages(spark, docs, tmp_path)
    for x in (language, dedup, clean, mixed):
        assert x.columns == start.columns
    texts = {r["doc_id"]: r for r in start.collect()}
    kept = {r["doc_id"] for r in language.collect()}
    assert kept == {i for i, r in texts.items() if any(c.isalpha() for c in r["text"] or "")}
    codes = {i: simhash.fingerprint(texts[i]["text"]) for i in kept}
    ids, root = sorted(kept), {}
    for i in ids:
        root[i] = i
        for j in ids[: ids.index(i)]:
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {r["doc_id"] for r in dedup.collect()} == set(root.values())
    assert all(r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"]) for r in clean.collect())
    assert {r["doc_id"] for r in clean.collect()} == set(root.values())
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts.values()) <= {1, 2} and set(counts) <= set(root.values())
    assert encoded.count() == sum(counts.values())
    again = C.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, encoded.collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", None, "a", 5), (None, "some words here to keep", "en", None, 23), (4, "same text as the other one", "en", "b", 26), (4, "same text as the other one", "en", "b", 26), (5, "ü" * 50_000, None, "b", 50_000)]
    out = run_stages(spark, spark.createDataFrame(rows, DOCS), tmp_path)
    assert {r["doc_id"] for r in out[1].collect()} == {None, 4, 5} and out[2].count() == 3 and out[5].count() >= 3


def test_stages_on_no_rows(spark, tmp_path):
    assert [x.count() for x in run_stages(spark, spark.createDataFrame([], DOCS), tmp_path)] == [0] * 6


def test_columns_of_the_queries(spark):
    want = {
        "op1_mpeg_audio": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op2_html_crf": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op3_quality_ratio": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op4_fair_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op6_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op8_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op10_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    }
    found = queries.queries()
    assert set(found) == set(want)
    for name, columns in want.items():
        df = found[name](spark, SF)
        types = dict(df.dtypes)
        assert {c: types.get(c) for c in columns} == columns, name
        table = {"op2_html_crf": "pages", "op8_chat_format": "conversations"}.get(name, "documents")
        key = df.columns[0]
        n = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count() + (name == "op8_chat_format")
        assert df.count() == n, name


def test_simhash_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, SF).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["fingerprint"] == f"{simhash.fingerprint(r['text']):016x}"
    codes = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    for i, a in codes.items():
        for j, b in codes.items():
            if (a ^ b).bit_count() <= 3:
                assert got[i]["component_id"] == got[j]["component_id"]


def test_personal_data_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op10_personal_data(spark, SF).collect()}
    for r in docs.collect():
        base = pii.base_spans(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in base).encode()).hexdigest()


def test_held_out_flags(spark):
    for r in queries.op7_language(spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    for r in queries.op9_toxicity(spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_stage_without_a_usable_label(spark):
    rows = [(i, f"some words to keep {i}", None, "a", 20) for i in range(5)] + [(9, "12 34", None, "a", 5)]
    assert sorted(r["doc_id"] for r in C.identify_language(spark, spark.createDataFrame(rows, DOCS), SF).collect()) == [0, 1, 2, 3, 4]
