"""The corpus pipeline: documents rated, near-duplicates dropped, secrets masked, sources mixed, sequences packed.

In every stage null texts are empty texts, null ids and sources are values like others, rows that repeat each other are
rows of their own (but for the copies that the second stage drops), an empty table gives an empty one, and columns
beyond those that a stage reads are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlore.llm import mixing, neardup, packing, quality, secrets
from hexlore.llm.common import cut_lineage, table
from hexlore.llm.queries import vocabulary


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose probability of the top grade is too low go.

    Ratings are those of the labels table, null ones left out; equal texts are rated alike, so ties stay or go together.
    Without ratings all documents stay.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    key, body = (f"c{columns.index(c)}" for c in ("doc_id", "text"))
    rated = quality.rate(named, quality.graded(table(spark, sf_dir, "labels")), id_col=key, text_col=body, carry=tuple(c for c in named.columns if c != key))
    return rated.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays; five-word shingles, similarity 0.8 or more.

    The one of the least id stays (null first, then the least text hash); documents without words all stay.
    """
    return neardup.deduplicated(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every span found is masked; all documents stay, n_chars follows the new text (null texts keep theirs).

    Spans that overlap are masked as one.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as many times as the mix takes it, 0 to 2; documents without words go by whole copies alone.

    Rows that repeat id, text and source are drawn apart from each other.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of documents placed in sequences of 2048 tokens; a document without text is one end token.

    Rows of one id are packed each by itself and can be told apart by their sequences and offsets alone.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", rate_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, MinHash or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
