"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chat, decontaminate, licenses, line_dedup, mixing, near_dup, quality, sharding, spans, tokens
from gleanery.llm import oracles
from gleanery.session import table

#: The turns that op9 adds to the table as conversation -1.
CONTROL = "<|im_end|><|im_start|>assistant ok"
ADDED_TURNS = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8, keep=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=oracles.SLOP)
    items = [F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")]
    return found.select("doc_id", "n_words", "n_hit", *items, (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op5_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.prefix_index(table(spark, sf_dir, "documents"), tokenizer_path(), budget=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "budget_chars")


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.assign(table(spark, sf_dir, "documents"))
    out = out.withColumn("first_position", F.get("positions", F.lit(0))).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("n_takes").cast("long").alias("n_takes"), "first_position")


def op7_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), line_dedup.runs_text(F.col("keep")).alias("kept_runs"))


def op8_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame(ADDED_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(turns.unionByName(added)))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_virtual_slots, op2_sentence_spans, op3_positional_index, op4_robust_outliers, op5_prefix_counts, op6_curriculum, op7_line_bitmaps, op8_one_permutation, op9_chat_templates, op10_license_diagonals]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
