"""One query per operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


MIX = {"temperature": 0.5, "budget": 1.0, "seed": 42}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, keep_order_key=True, **MIX)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    return drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import clean_lines

    return clean_lines(read_table(spark, sf_dir, "documents"), keep_text=False)


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import media_columns

    return media_columns(read_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_mixing, op3_lm_scoring, op4_language_id, op5_line_dedup, op6_token_counts, op7_simhash, op8_quality, op9_ogg, op10_toxicity)
}
