"""Mixing and chat formatting: against SQL, against a slow queue, and on odd rows; without Python on the executors."""

import hashlib
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import chat, fair_mix, queries, sql
from verify_oracle import canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["op4_fair_mix", "op8_chat_format"])
def test_equals_sql_and_stays_in_the_jvm(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert canonical(df.toPandas()).equals(canonical(duck.execute(sql.oracle_sql()[name]).fetchdf()))


# mixing


def slow_targets(sizes: list[int], weights=(5, 2, 1), share=1.5, most=2) -> list[float]:
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, full, budget = [0.0] * len(sizes), set(), share * sum(sizes)
    while len(full) < len(sizes):
        level = (budget - sum(most * sizes[i] for i in full)) / sum(w[i] for i in range(len(sizes)) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and level * w[i] >= most * sizes[i]}
        if not over:
            break
        full |= over
    for i in range(len(sizes)):
        out[i] = most * sizes[i] if i in full else level * w[i]
    return [float(x) for x in out]


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1000, 1, 1], [5], [0, 7, 100], [1, 1000, 1000, 3, 50], [0, 0]])
def test_targets_fill_like_water(spark, sizes):
    rows = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "m_source string, source_size bigint")
    got = [r["target"] for r in fair_mix.targets(rows, (5, 2, 1), 1.5, 2).orderBy("m_source").collect()]
    want = slow_targets(sizes) if sum(sizes) else [0.0] * len(sizes)
    assert got == pytest.approx(want)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix_keeps_to_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else None) for i in range(3000)] + [(9000 + i, "x y z", f"s{i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = fair_mix.plan_mix(fair_mix.queue_of(docs)).collect()
    taken, target = {}, {}
    for r in mixed:
        taken[r["m_source"]] = taken.get(r["m_source"], 0) + r["size"] * r["copies"]
        target[r["m_source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert all(abs(taken[s] - t) <= 8 + 0.002 * t for s, t in target.items())
    out = fair_mix.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mixed)
    again = fair_mix.plan_mix(fair_mix.queue_of(docs.repartition(9))).collect()
    assert {(r["m_id"], r["copies"]) for r in mixed} == {(r["m_id"], r["copies"]) for r in again}


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "w " * 50_000, "b"), (4, "a b", None), (4, "a b", None), (None, "c d", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS size", "1 AS m_id", "2 AS slot", "3 AS target")
    got = fair_mix.mix_documents(docs).collect()
    assert all(len(r) == 7 for r in got)
    assert fair_mix.mix_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fair_mix.plan_mix(fair_mix.queue_of(docs), share=3)


def test_mix_of_null_ids_equal_rows_and_maps(spark):
    texts = [None, "", "a b", "c d e", "f"]
    rows = [(None, texts[i % 5], "s") for i in range(2000)] + [(None, f"t{i} u", "s") for i in range(500)] + [(1, f"v{i}", None) for i in range(200)] + [(2**60 + i, "w x y", "r") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "map('k', text) AS extra")
    queue = fair_mix.queue_of(docs)
    assert queue.select("m_hash").distinct().count() > 700  # rows without an id are not all in one place
    mixed = fair_mix.plan_mix(queue).collect()
    assert len(mixed) == len(rows) and all(0 <= r["copies"] <= 2 for r in mixed)
    of = {}
    for r in mixed:
        of.setdefault((r["m_id"], r["m_source"], r["size"], r["m_hash"]), set()).add(r["copies"])
    assert all(len(c) == 1 for c in of.values())
    target, taken = {r["m_source"]: r["target"] for r in mixed}, {}
    for r in mixed:
        taken[r["m_source"]] = taken.get(r["m_source"], 0) + r["size"] * r["copies"]
    largest = 400 * 3  # equal rows are taken together
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    out = fair_mix.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mixed)


# chat


def test_parts_round_trip(spark):
    P = chat.PARTS
    rows = [
        (1, 1, "user", [("text", "look <|end|> & [INST]", None, None), ("image", None, "img://1", 3), ("text", " at it", None, None), ("document", None, "doc://1", None)]),
        (1, 2, "assistant", [("text", "ok <|image:5|> &lt;", None, None)]),
        (1, 3, "tool|x", [("audio", None, "au://1", 10)]),
        (2, 1, "assistant", None),
        (2, 2, None, []),
        (2, 3, "assistant", [("strange", "as text", None, None), (None, None, None, None)]),
        (None, 1, "user", [("text", None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {P}").selectExpr("*", "'x' AS body", "1 AS at", "2 AS places", "3 AS tokens")
    done = chat.format_turns(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in done.collect()}
    one = got[1]
    assert one["formatted"] == "<|user|>look &lt;|end|> &amp; &lsqb;INST]<|image:768|> at it<|document:512|><|end|><|assistant|>ok &lt;|image:5|> &amp;lt;<|end|><|tool&vert;x|><|audio:250|><|end|>"
    assert [(t["role"], t["body"]) for t in one["turns"]] == [("user", "look <|end|> & [INST]<|image:768|> at it<|document:512|>"), ("assistant", "ok <|image:5|> &lt;"), ("tool|x", "<|audio:250|>")]
    assert one["loss"] == "ok <|image:5|> &lt;"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(1, 1, "image", "img://1", 768), (1, 3, "document", "doc://1", 512), (3, 0, "audio", "au://1", 250)]
    assert one["n_tokens"] == 4 + 768 + 2 + 512 + 3 + 250
    assert [(t["role"], t["body"]) for t in got[2]["turns"]] == [("assistant", ""), ("", ""), ("assistant", "as text")] and got[2]["loss"] == "as text"
    assert got[None]["formatted"] == "<|user|><|end|>"
    assert chat.format_turns(turns.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|end|>", "&lt;", "&amp;lt;", "<|user|>\n", "a|b", "\U0001f600 é", "", "&lsqb;", "x" * 100_000])
def test_control_strings_come_back(spark, text):
    rows = spark.createDataFrame([(1, 1, text, text), (1, 2, "assistant", text)], "conv_id int, turn int, role string, text string")
    r = chat.format_turns(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).select("formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in r["t"]] == [(text, text), ("assistant", text)]
    assert r["loss"] == text * (2 if text == "assistant" else 1)
    assert "[INST]" not in r["formatted"] and r["formatted"].count("<|end|>") == 2


def test_repeated_turns_stay(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a")] * 3, "conv_id int, turn int, role string, text string")
    r = chat.format_turns(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).first()
    assert r["formatted"] == "<|user|>a<|end|>" * 3


def test_query_holds_the_control_conversation(spark):
    r = queries.op8_chat_format(spark, SF).filter("conv_id = -7").first()
    c = queries.CONTROL
    assert r["n_turns"] == 2 and r["turns_sha256"] == hashlib.sha256(f"user\n{c}\nassistant\n{c}\n".encode()).hexdigest()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(c), hashlib.sha256(c.encode()).hexdigest())
