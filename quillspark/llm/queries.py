"""The registered queries over these operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_turns, unescape
from .common import shared_folder, table
from .decontaminate import find_benchmark
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .quality_model import score_quality
from .quality_rules import quality_rules
from .resampling import importance_ranks
from .secrets import scan_secrets
from .simhash import label_documents
from .substring_dedup import dedup_substrings
from .token_files import read_token_files, write_token_files
from .vector_codes import code_vectors, codebooks_hash, told_code, with_label_errors


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["first_word"], s["last_word"], F.round(s["coverage"], 4)))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_spans"), F.coalesce(F.array_max(F.transform("licenses", lambda s: s["coverage"])), F.lit(0.0)).alias("coverage"), F.array_join(told, ",").alias("licenses"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, read back from what was formatted."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard))
    turns = read_turns(F.col("formatted"))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), masked.alias("masked"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), by_words=True, end_id=2, vocabulary=49_408)
    out = read_token_files(spark, folder)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = code_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = with_label_errors(coded.select("vec_id", "label", "code", "error"))
    return out.select("vec_id", told_code(F.col("code")).alias("code"), "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_line_dedup, op2_quality_rules, op3_simhash, op4_secrets, op5_mixing, op6_decontamination, op7_quality_model, op8_licenses, op9_substring_dedup, op10_chat_format, op11_token_files, op12_vector_codes, op13_resampling)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}
