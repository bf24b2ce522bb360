"""A corpus pipeline in five stages, each calling one operator of ``tallyweir.llm``.

1. quality_rules: documents that fail the production policy go.
2. near_duplicates: of every group linked by 5-gram Jaccard similarity the document with the smallest id stays.
3. decontamination: documents with at least 5 % of their words in windows of benchmark items go.
4. personal_data: confirmed spans are replaced by the name of their kind; n_chars follows.
5. pieces: the text's number of pieces, and hashes of the ids and of what they decode to.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``, with further columns of
the input kept. Rows are told apart by id and text: different texts of one id, or without an id, are different
documents. A null text is an empty one to every rule and fails the first stage; of equal rows, which are near duplicates
of each other, one stays; an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm import decontaminate, jaccard, pieces, pii, quality
from tallyweir.llm.links import stored, stored_ids
from tallyweir.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
POLICY = "v3"
KEY = "__key"


def _rows(docs: DataFrame) -> DataFrame:
    """The rows as one column beside the text, so that no column of an operator can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    return quality.ledger(_rows(docs)).where(quality.passes(POLICY)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every component of links; equal rows are one document."""
    differ = jaccard.ids_differ(docs)
    found = jaccard.row_components(docs.select("doc_id", "text"), differ)
    if not differ:  # keys are hashes then, and the smallest key need not have the smallest id
        first = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("component")
        leaders = found.groupBy(F.col("component").alias("group")).agg(first)
        found = found.withColumnRenamed("component", "group").join(leaders, "group")
    gone = found.where("component <> key").select(F.col("key").alias("__gone"))
    few = jaccard.few_rows(stored_ids(gone, "gone"))
    kept = docs.withColumn(KEY, jaccard.row_key(differ)).join(few, F.col(KEY) == F.col("__gone"), "left_anti")
    return (kept if differ else kept.dropDuplicates([KEY])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark of ``sf_dir``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.contamination(docs.select("doc_id", "text"), items)
    gone = judged.where("contaminated").select(F.col("doc").alias("__gone"), F.col("text_hash").alias("__hash"))
    few = jaccard.few_rows(stored_ids(gone, "gone"))
    keyed = docs.withColumn(KEY, F.xxhash64("text"))
    return keyed.join(few, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.col(KEY) == F.col("__hash")), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced, and n_chars counted anew."""
    replaced = {"text": F.col("redacted"), "n_chars": F.char_length("redacted").cast("long")}
    found = pii.redact(_rows(docs))
    return found.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def piece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256."""
    return pieces.round_trip_digests(docs.select("doc_id", "lang", "source", "n_chars", "text"))


def _shipped(stage: Stage) -> Stage:
    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    (name, _shipped(stage))
    for name, stage in (
        ("quality_rules", quality_rules),
        ("near_duplicates", near_duplicates),
        ("decontamination", decontamination),
        ("personal_data", personal_data),
        ("pieces", piece_round_trip),
    )
]
#: SQL can't express the last stage; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written once and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
