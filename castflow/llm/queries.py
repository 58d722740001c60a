"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow.llm import chat_format, decontaminate, fill_in_middle, hard_negatives, huffman, line_dedup, ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash, sql
from castflow.llm import common as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier fitted on labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    weights, bias = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~fold))
    scored = quality_classifier.score(docs, weights, bias)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all documents, and the verdict of the line-frequency rule."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, equal texts together."""
    sharded = sharding.balanced(table(spark, sf_dir, "documents"), shards=8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the near-equal lines that an earlier document holds."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Huffman-coded blocks of token ids, written and read back."""
    path = C.scratch(spark, "token-ids")
    huffman.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return huffman.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.harmonic(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts look like marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds marks, formatted, written and read back."""
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    path = C.scratch(spark, "chat")
    chat_format.write(rows, path, public_tokenizers.path("byte_bpe_50k.json"))
    return chat_format.digests(spark, path).drop("n_tokens", "loss_tokens")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents, with weak parts that stand near their complement."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of other labels for each anchor and positive, of the vectors with some labels moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the components that fingerprints within three bits make."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at two token boundaries, with hashes of the outputs and of the texts rebuilt from them."""
    return fill_in_middle.digests(fill_in_middle.transform(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": sql.NGRAM_JACCARD, "op3_quality_rules": sql.QUALITY_RULES, "op9_chat_format": sql.chat_format(MARKED), "op10_secret_scan": sql.secret_scan(200), "op11_hard_negatives": sql.HARD_NEGATIVES, "op13_fill_in_middle": sql.FILL_IN_MIDDLE}
