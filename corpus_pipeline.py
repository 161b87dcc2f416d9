"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm import op1_langid, op4_mixing, op5_packing, op6_dedup, op7_secrets
from tabulark.llm.common import forget, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the others go.

    Null and empty texts and texts without a letter have none.  Rows of one text
    are judged alike, equal rows all stay; every column stays as it is; a table
    without a label, or an empty one, keeps nothing.
    """
    return op1_langid.known_only(docs, op1_langid.fit(op1_langid.training(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies.

    Null texts count as empty and are copies of each other; texts without a word
    are copies only if equal; of equal rows one stays; rows without an id stay
    if nothing else of their group has one; an empty table stays empty.
    """
    return op6_dedup.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced, n_chars with them.

    Null and empty texts stay; overlapping secrets are replaced as one; equal
    rows are treated alike; other columns stay; an empty table stays empty.
    """
    return op7_secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as often as its source's weight asks for.

    Null sources are one source; documents without a token (null and empty
    texts) pass once if all their source has none; equal rows go together, their
    order by hash has no ties else; an empty table stays empty.
    """
    return op4_mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    Null and empty texts are a piece of the end id alone; texts of any length are
    cut into pieces; equal rows are packed each for itself; an empty table gives
    no piece.
    """
    return op5_packing.pack(docs, op5_packing.tokenizer_path())


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("secret scan", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            forget(before)
    return docs


#: Kernel scores, darts and a linear program are not for SQL.
ORACLE_SQL = None
