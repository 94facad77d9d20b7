"""Documents to training tokens: language, near-duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and is written before the next one
reads it. All but the last return the columns of documents. Empty tables pass through as empty ones; columns other
than those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import table, written
from fleetlens.llm.op2_jaccard import jaccard_classes
from fleetlens.llm.op4_language import UNKNOWN, identify, learn
from fleetlens.llm.op5_bpe import digests, encode_and_decode
from fleetlens.llm.op7_pii import find_pii, redact
from fleetlens.llm.op8_mix import mix_sources, sized_documents, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Code points encoded together: small chunks, as workers still hold memory of the stages before.
ENCODED = 4_000_000

#: The language search, the search for near-duplicates and the encoding have no counterpart in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or letterless texts) go; a missing ``lang`` is filled with the predicted one."""
    docs = docs.select(COLUMNS)
    labelled = identify(docs, learn(docs), spans=False).filter(F.col("lang_pred") != UNKNOWN)
    return labelled.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id stays; rows that repeat a document stay once.

    Documents without an id cannot be told apart and all stay. Rows of one id with different texts stay or go together.
    """
    kept = written(jaccard_classes(docs).filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(COLUMNS).union(docs.filter("doc_id is null").select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind in brackets; ``n_chars`` follows the new text."""
    cleaned = redact(find_pii(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix emits it; documents that it passes over go.

    Rows that repeat a document all get the largest number of copies among them; rows without an id are one document.
    """
    size = word_count(F.col("text"))
    mixed = mix_sources(sized_documents(docs, size))
    copies = mixed.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    copies = copies.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "copies")])
    same = docs["doc_id"].eqNullSafe(copies["_doc_id"]) & docs["source"].eqNullSafe(copies["_source"]) & (size == copies["_size"])
    return docs.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, a row for every copy."""
    return digests(encode_and_decode(docs, chunk=ENCODED))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
