"""The corpus pipeline: language ID, line dedup, near-dedup, PII, packing.

Each stage takes and, but for the last, returns the columns of documents. The language stage drops documents whose
language cannot be told; line dedup rewrites texts; near-dedup keeps one document of each group; the PII stage replaces
personal data and disclosing terms; packing returns the pieces with their places. Columns of other names come through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, packing, pii, simhash
from tessera.llm.common import release, stage

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language that can be learnt from `docs`; see language_id.is_rejected.

    Null and empty texts and texts without a letter go. So do longer texts that are familiar with no learnt language.
    Without any labelled row all go. Repeated rows stay or go together; very long texts are read whole.
    """
    return language_id.identify(docs).where(~language_id.is_rejected()).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that repeat earlier passages; see line_dedup.dedup_lines.

    Nulls stay; a text whose lines all repeat becomes empty. Repeated rows are rewritten alike.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; see simhash.keep_one.

    Shingles have five words, and similarity is 0.8 or more. Null and empty texts are copies of each other, rows without
    doc_id come last, and of repeated rows one stays. Very long texts are compared whole, an empty table gives none, and
    columns of any name come through.
    """
    return simhash.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and disclosing terms replaced by tags; see pii.sanitise.

    Nulls stay, very long texts are read whole, repeated rows are rewritten alike, an empty table gives none, and columns of
    any name come through.
    """
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; see packing.pack_documents. Null text is an end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("PII", sanitise),
    ("packing", pack),
]

#: Kernel scores, tokenizers and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of documents. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        last, docs = docs, stage(function(spark, docs, sf_dir))
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
