"""One query for each operator, with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, hmm, langid, minhash, minslack, packing, periodic, repair, simhash, substrings, toxicity
from .common import read

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.shared_passages(read(spark, sf_dir, "documents"), least=45)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), cut=0.7, most=12_000)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    out = chat.format_chat(turns.unionByName(planted))
    back = chat.parse(F.col("formatted"))
    shown = F.concat_ws("", F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = chat.loss_text()
    return out.select(
        "conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(read(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, capacity=2048, end_id=0)


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(read(spark, sf_dir, "documents"), passes=2, start_docs=1000)


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, tables=8, probes=16)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"), most=1500)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.planted_runs(read(spark, sf_dir, "documents")), least=12)
    longest = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).otherwise(F.sign(x["start"] - y["start"])).cast("int")), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "run.start", "run.length", "run.period", F.expr("1000 * run.length div run.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minslack.pack_min_slack(read(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    report, repaired = repair.repair(repair.damaged(turns))
    every = turns.select("conv_id").distinct()
    report, shown = (d.withColumnRenamed("conv_id", "_conv") for d in (report, repair.digests(repaired)))
    out = every.join(report, every.conv_id.eqNullSafe(report._conv), "left").drop("_conv")
    out = out.join(shown, out.conv_id.eqNullSafe(shown._conv), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_toxicity, op4_minhash_dedup, op5_simhash, op6_chat_format, op7_best_fit_packing, op8_hmm_scores, op9_cross_polytope, op10_language_id, op11_periodic_runs, op12_min_slack_packing, op13_conversation_repair)}

_CODED = "replace(replace(replace(replace(replace({x}, '\\', '\\b'), '</s>', '\\e'), '<s>', '\\s'), '[INST]', '\\i'), '[/INST]', '\\o')"
_PLAIN = "replace(replace(replace(replace(replace({x}, '\\o', '[/INST]'), '\\i', '[INST]'), '\\s', '<s>'), '\\e', '</s>'), '\\b', '\\')"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        shown AS (
            SELECT *, 20 + length(role) + CASE
                WHEN {_PLAIN.format(x="text")} <> text OR contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
                THEN length({_CODED.format(x="text")}) ELSE length(text) END AS size
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(size)::BIGINT AS formatted_chars
        FROM shown GROUP BY conv_id""",
}
