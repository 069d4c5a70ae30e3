"""Named queries of the operators over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import held_out
from palaver.llm.counts import count_tokens
from palaver.llm.language import detect_language, fit_language
from palaver.llm.mixing import MIXING_SQL, mix_sources, n_words
from palaver.llm.near_text import MinHash, near_duplicates
from palaver.llm.near_vectors import near_vectors
from palaver.llm.pieces import encode_pieces
from palaver.llm.privacy import find_privacy, fit_privacy
from palaver.llm.quality import fit_quality, score_quality
from palaver.llm.rules import judge, rules_sql
from palaver.llm.toxicity import fit_toxicity, score_toxicity
from palaver.llm.url_filter import UrlRule, judge_urls, urls_sql
from palaver.llm.variants import group_variants, planted_words
from palaver.llm.whitening import fit_whitening, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_quality_votes")
def op1_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = fit_quality(documents, table(spark, folder, "labels"))
    return score_quality(documents, model, keep=["doc_id"]).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


@query("op3_toxicity_neighbours")
def op3_toxicity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    index = fit_toxicity(documents, table(spark, folder, "labels"))
    return score_toxicity(documents, index, keep=["doc_id"]).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "evidence")


@query("op4_quality_rules", rules_sql())
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_mixed_sources", MIXING_SQL)
def op7_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source", n_words().alias("size"))
    return mix_sources(documents, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_private_spans")
def op2_private_spans(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return find_privacy(documents, fit_privacy(documents), keep=["doc_id"])


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op6_pieces")
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encode_pieces(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


@query("op8_language_field")
def op8_language_field(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = fit_language(documents)
    return detect_language(documents, model, keep=["doc_id"]).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


@query("op5_near_texts")
def op5_near_texts(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), MinHash(width=3, threshold=85))


@query("op9_near_vectors")
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


URL_RULES = [UrlRule.of(x) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


@query("op11_url_verdicts", urls_sql(URL_RULES))
def op11_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "score", "verdict")


@query("op12_whitened_vectors")
def op12_whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return whiten(embeddings, fit_whitening(embeddings))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return group_variants(planted_words(table(spark, folder, "documents")))
