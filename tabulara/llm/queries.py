"""The queries p6 to p8 over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulara.llm import packing, subjects, tokens
from tabulara.session import cut, spread

#: Least precision and recall against doc_label, whose labels hold mistakes and omissions.
AGREEMENT = 0.9


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_documents(spark, d))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the text that the ids of each document decode to."""
    return tokens.decoded_hashes(p6_ids(spark, d)).select("doc_id", "sha256")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(tokens.token_counts(_documents(spark, d)), _table(spark, d, "kapasitas"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    kinds = _table(spark, d, "kapasitas")
    return packing.container_fill(packing.fill_containers(tokens.token_counts(_documents(spark, d)), kinds, started=True), kinds)


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents, containers beyond it, and texts cut that it holds whole."""
    return packing.container_faults(p7_containers(spark, d), _table(spark, d, "kapasitas"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    encoded = cut(subjects.encode_sentences(_documents(spark, d)))
    return subjects.assign_subjects(encoded, subjects.fit_topics(encoded), _table(spark, d, "subject_area"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_assigned(spark, d), _table(spark, d, "subject_area"))


def p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether precision and recall against the hand labels, which no fit or name has seen, reach AGREEMENT."""
    labels = _table(spark, d, "doc_label")
    right = labels.where("subject IS NOT NULL").select("doc_id", "subject", F.lit(1).alias("right")).distinct()
    mine = p8_found(spark, d).join(labels.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("mine", F.lit(1))
    n = mine.join(right, ["doc_id", "subject"], "full").agg(F.count_if((F.col("mine") == 1) & (F.col("right") == 1)).alias("both"), F.count("mine").alias("mine"), F.count("right").alias("right"))
    holds = lambda name, of: F.struct(F.lit(name).alias("measure"), F.coalesce(F.col("both") >= AGREEMENT * F.col(of), F.lit(False)).alias("holds"))
    return n.select(F.inline(F.array(holds("precision", "mine"), holds("recall", "right"))))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    return subjects.topic_terms(documents, subjects.fit_topics(cut(subjects.encode_sentences(documents))), _table(spark, d, "subject_area"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_ids, p6_decoded, p7_containers, p7_fill, p7_faults, p8_found, p8_composition, p8_agreement, p8_topics)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "p7_faults": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0 AS n_cut, 0 AS n_over FROM (SELECT DISTINCT capacity_id FROM kapasitas WHERE max_tokens > 0)",
        "p8_agreement": "SELECT 'precision' AS measure, true AS holds UNION ALL SELECT 'recall', true",
    }
