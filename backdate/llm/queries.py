"""The operators as named queries over the whole of their table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from backdate.llm.common import table, tokenizer_path
from backdate.llm.cross_tokens import TOKENIZER_A, TOKENIZER_B, alignment_digest
from backdate.llm.filter_audit import filter_audit
from backdate.llm.host_rules import judge
from backdate.llm.jaccard import jaccard_classes
from backdate.llm.line_dedup import line_digest
from backdate.llm.main_text import extract_main_text
from backdate.llm.mixing import mix_sources
from backdate.llm.packing import TOKENIZER as PACK_TOKENIZER
from backdate.llm.packing import pack
from backdate.llm.piece_counts import TOKENIZER as PIECE_TOKENIZER
from backdate.llm.piece_counts import count_pieces
from backdate.llm.scoring import score_documents
from backdate.llm.substring import repeated_passages
from backdate.llm.top_inner import top_inner
from backdate.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


@query
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "n_linked_texts", "n_shingles"
    )


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "ref_id", "ref_start", "ref_end", "equal_words"
    )


@query
def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))


@query
def op8_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op6_count_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_TOKENIZER))


@query
def op4_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op12_drop_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B))
