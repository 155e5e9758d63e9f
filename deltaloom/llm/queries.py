"""The opN_ queries: each operator over its whole table, as the digests that can be compared."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import chat, common, fair_mix, html_crf, langid, mpeg_audio, pii, quality_llr, simhash, spm, toxicity
from deltaloom.llm.samples import remainder

#: The SentencePiece model; ``LLM_TOKENIZERS`` names another folder of the public tokenizers' files.
MODEL = f"{os.environ['LLM_TOKENIZERS']}/piece_bpe_32k.model" if "LLM_TOKENIZERS" in os.environ else public_tokenizers.path("piece_bpe_32k.model")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(common.table(spark, sf_dir, "documents"))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_crf.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks")


def op3_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    ratios = quality_llr.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_llr.rate(docs.select("doc_id", "text"), ratios).drop("text")


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mix.plan_mix(fair_mix.queue_of(common.table(spark, sf_dir, "documents")))
    return mixed.select(F.col("m_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = common.durable(simhash.fingerprints(common.table(spark, sf_dir, "documents")))
    return simhash.near_duplicates(coded).select("doc_id", simhash.hex_code("code").alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoding_digest(common.table(spark, sf_dir, "documents"), MODEL)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = langid.detect(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


CONTROL = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = rows.unionByName(extra)
    done = chat.format_turns(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    read = done.select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), said.alias("said"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pii.find(docs.select("doc_id", "text"), pii.disclosing(docs)).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mpeg_audio, op2_html_crf, op3_quality_ratio, op4_fair_mix, op5_simhash, op6_sentencepiece, op7_language, op8_chat_format, op9_toxicity, op10_personal_data)}
