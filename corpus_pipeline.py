"""From raw documents to token ids: quality, near duplicates, personal data, mixing, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.mixing import mix_sources
from palaver.llm.near_text import MinHash, near_duplicates
from palaver.llm.pieces import encode_pieces
from palaver.llm.privacy import find_privacy, fit_privacy
from palaver.llm.quality import fit_quality, score_quality
from palaver.llm.queries import tokenizer_path
from palaver.session import durable


def _beside(docs: DataFrame, names: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` while columns of the documents that have one of the names it adds are set aside."""
    aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c in names}
    done = work(docs.withColumnsRenamed(aside))
    return done.drop(*aside).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts call good; without labels all stay. An empty or null text is judged as empty."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return _beside(docs, ["score", "predicted"], lambda d: score_quality(d, model).where("predicted = 1"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    The one with the least id stays; of rows with one id and one text, one. Texts without words and rows with a null id stay.
    """
    verdict = durable(near_duplicates(docs.select("doc_id", "text"), MinHash()))
    ids = verdict.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = durable(ids.where("not _kept or _rows > 1"))  # most ids are neither dropped nor repeated
    marked = docs.select("*", F.col("doc_id").alias("_id")).join(odd.withColumnRenamed("doc_id", "_id"), "_id", "left")
    single = marked.where("_rows is null").select(*docs.columns)
    repeated = marked.where("_kept and _rows > 1").dropDuplicates(["_id", "text"] if "text" in docs.columns else ["_id"])
    return single.unionByName(repeated.select(*docs.columns))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by [KIND]; n_chars follows the new text, a null text stays null."""
    model = fit_privacy(docs)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]

    def work(d: DataFrame) -> DataFrame:
        found = find_privacy(d, model, redacted=True)
        text = F.when(F.col("text").isNotNull(), F.col("redacted"))
        found = found.withColumn("text", text)
        return found.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else found

    return _beside(docs, names, work)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 rows."""
    names = ["size", "source_size", "target", "taken", "copies", "place"]
    return _beside(docs, names, lambda d: mix_sources(d).where("copies > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of the ids and of the decoded text."""
    made = encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "source"], ids=True)
    return made.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_duplicates", near), ("privacy", privacy), ("mixing", mixing), ("pieces", pieces)]

#: A learnt classifier has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
