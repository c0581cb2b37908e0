"""One query per training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, dart_minhash, lexical, line_templates, mixing, packing, phrases, piecewise_hash, quality, super_kmers, token_blocks, toxicity, url_filter
from .common import scratch_path

#: Rows of an Arrow batch in these queries: texts can be long.
ARROW_ROWS = "2000"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as blocks and read back."""
    path = scratch_path(spark, "token-blocks")
    token_blocks.write_token_blocks(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    index = token_blocks.token_index(spark.read.parquet(path))
    return index.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page's URL, by rule or by the model."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filtered(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for each document."""
    rows = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    rows = mixing.mixed(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("k").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness."""
    return piecewise_hash.fingerprints(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without windows that smaller documents have."""
    rows = super_kmers.removal(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids, each in proportion to the sources."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each document."""
    docs = _table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those dropped as recurring templates, and what is left."""
    rows = line_templates.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates."""
    return dart_minhash.classified(_table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents by merging, and the texts they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two and three words that stand together most."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 20 best documents."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_piecewise_hash": op5_piecewise_hash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_toxicity": op8_toxicity,
    "op9_line_templates": op9_line_templates,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_bpe": op11_bpe,
    "op12_phrases": op12_phrases,
    "op13_lexical_search": op13_lexical_search,
}

#: The same rows in DuckDB SQL, where SQL can say it; tests/llm compares the others with brute force.
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.oracle(),
    "op6_substring_dedup": super_kmers.oracle(),
    "op9_line_templates": line_templates.oracle(),
    "op12_phrases": phrases.oracle(),
    "op13_lexical_search": lexical.oracle(),
}
