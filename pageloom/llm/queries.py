"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    collocations,
    decontaminate,
    embedding_join,
    gam,
    html_blocks,
    licenses,
    ppm,
    secret_scan,
    simhash,
    spelling,
    substring_dedup,
    winnowing,
)
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The findings; of the table's columns ``source`` says most about where a text was found."""
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    return secret_scan.scan_secrets(table(spark, folder, "documents"), forest, path=F.col("source"))


@query()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extract_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = gam.fit_quality(documents, table(spark, folder, "labels"), fold(3) != 1)
    scored = gam.score_quality(documents.select("doc_id", "text"), model)
    held_out = (fold(3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), shingle=3, max_bits=2)


def vocabulary_path() -> str:
    """The vocabulary of the queries; it is read where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, folder, "documents").select("doc_id", "text"), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, folder, "documents"))


@query()
def op9_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score_documents(table(spark, folder, "documents"), fold(7) == 2)


@query()
def op10_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeated(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(licenses.SQL)
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no paths; source, language and id stand for directories and file."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan_licenses(table(spark, folder, "documents").select(path.alias("path"), "text"))


@query(collocations.SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    candidates = collocations.collocations(table(spark, folder, "documents"))
    return collocations.best_collocations(candidates).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query()
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, folder, "documents"))


@query(embedding_join.SQL)
def op13_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, folder, "embeddings"))
