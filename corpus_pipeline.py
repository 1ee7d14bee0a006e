"""A corpus pipeline: toxicity, repeated lines, near-duplicates, mixing and packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, simhash, toxicity
from tidemark.llm._common import WORD, read_table, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels beside ``documents``, scores under its threshold."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated runs of lines; those of which no word is left go."""
    out = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    emptied = (F.col("lines_after") < F.col("lines_before")) & ~F.col("text").rlike(WORD)
    count = F.when(F.col("lines_after") < F.col("lines_before"), F.length("text")).otherwise(F.col("n_chars"))
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, so that a source's share is as the square root of its size."""
    return mixing.mix(docs.select(*COLUMNS), temperature=0.5, budget=1.0, seed=42)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the tokenizer, so the stages are tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
