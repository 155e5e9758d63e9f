"""Every operator over documents whose other columns bear the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from deltaloom.llm import chat, html_crf, langid, mpeg_audio, pii, quality_llr, queries, simhash, spm, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (1, "hello world this is the first text of all " * 9, "en", "a", 5),
    (None, "hello world this is the first text of all " * 9, "en", "a", 5),
    (2, None, None, None, None),
    (2, "", "en", None, 0),
    (None, "mail a@b.org now ip 1.2.3.4 \U0001f600", "de", "b", 1),
    (1 << 60, "42 4242", "en", "a", 7),
    ((1 << 60) + 1, "x" * 300_000 + " y", "en", "c", 7),
    (7, "wort eins zwei drei vier", "de", "b", None),
    (7, "wort eins zwei drei vier", "de", "b", None),
]
NAMES = "m_text m_id m_key m_got m_label m_source m_hash m_lang m_row m_copies m_again m_has_letter m_0 m_1 d id row n label code key mask size copies target k col kind value term q s r a.b component_id score spans".split()


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark, tmp_path_factory):
    made = spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)
    made = made.select("*", *[F.lit("z").alias(n) for n in NAMES], F.create_map(F.lit("a"), F.lit(1)).alias("mm"), F.array(F.lit(None).cast("int")).alias("arr"))
    folder = str(tmp_path_factory.mktemp("clash") / "docs")
    made.write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("stage", range(len(C.STAGES)), ids=[name for name, _ in C.STAGES])
def test_stage(spark, docs, stage):
    got = C.STAGES[stage][1](spark, docs, "").collect()
    by_stage = {0: 6, 1: 6, 2: 9, 4: 9}  # three rows have no letter; three pairs of rows are near-duplicates
    if docs.isEmpty():
        assert not got
    elif stage in by_stage:
        assert len(got) == by_stage[stage]
    if stage < len(C.STAGES) - 1:
        assert all(list(r.asDict()) == docs.columns and {r[n] for n in NAMES} == {"z"} and r["mm"] == {"a": 1} for r in got)


@pytest.mark.parametrize("name", ["quality", "language", "toxicity", "personal", "encoding"])
def test_fields_are_added(docs, labels, name):
    got = {
        "quality": lambda: quality_llr.rate(docs, quality_llr.fit(docs, labels)),
        "language": lambda: langid.detect(docs, langid.train(docs), spans=True, letters=True),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels), spans=True),
        "personal": lambda: pii.find(docs, pii.disclosing(docs)),
        "encoding": lambda: spm.encode_documents(docs, queries.MODEL),
    }[name]()
    rows, own = got.collect(), set(NAMES) - {"score", "spans"}
    assert len(rows) == docs.count() and set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert all(r[n] == "z" for r in rows for n in own)


def test_digests(docs):
    n = docs.count()
    assert [r["doc_id"] for r in mpeg_audio.media_digest(docs).collect()].count(None) == (2 if n else 0)
    coded = simhash.fingerprints(docs)
    assert simhash.near_duplicates(coded).count() == n


def test_pages_and_turns(docs):
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), F.lit(1).alias("n_blocks"))
    assert html_crf.extract(pages).count() == docs.count()
    turns = docs.drop("text").select("*", F.col("doc_id").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), chat.text_part(F.col("source")).alias("parts"), *[F.lit(1).alias(c) for c in ("at", "head", "body", "places", "tokens", "start")])
    assert chat.format_turns(turns).count() == docs.select("doc_id").distinct().count()
