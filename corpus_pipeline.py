"""A training corpus from `documents`: language ID, exact and near deduplication, mixing, token ids.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the stage before kept, and all but the last
return the columns of `documents`. `run` writes every stage's result as Parquet into the shared folder and reads it again.

Verdicts find their rows by where these stand in their Parquet files (`verdicts.named`), never by doc_id alone. Defined edge cases, for
every stage: rows with a null doc_id, rows that share one and repeated rows are rows of their own; an empty table gives an empty result;
extra columns pass by, whatever their names. What each stage does with null and empty texts is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, digest_index, lang_id, mixing, near_dup, verdicts
from lamina.llm.queries import tokenizer_file
from lamina.session import materialize, scope, ship, sized, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null or empty text, no letter, or two languages that fit equally well."""
    ship(spark)
    return lang_id.accepted_rows(docs, lang_id.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts: that with the largest doc_id, any of those that share it, and any if none has one. Null is the
    empty text."""
    columns, docs = docs.columns, verdicts.named(docs)
    found = digest_index.exact_dedup(docs, batches=1, keep=verdicts.NAME)
    return verdicts.keep_one(docs, found, "text_sha256").select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies at similarity 0.85: that with the smallest doc_id, any of those that share it, and any
    if none has one. Rows with a null text or without words are of no class and all stay."""
    columns, docs = docs.columns, verdicts.named(docs)
    ship(spark)
    return verdicts.keep_one(docs, near_dup.near_duplicates(docs, rows=True), "class").select(columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each row the words that the source mix takes: repeated, in part, or not at all. Rows of which nothing is taken, such as
    those with a null text or without words, go; `n_chars` becomes the new text's."""
    columns, docs = docs.columns, verdicts.named(docs)
    ship(spark)
    taken = mixing.mix_sources(docs, keep=verdicts.NAME).where("taken > 0")
    taken = taken.select(*verdicts.NAME, *[F.col(c).alias(f"__mix_{c}") for c in ("size", "taken", "spans")])
    rows = docs.join(sized(taken, "taken"), verdicts.NAME)
    rows = rows.withColumn("text", mixing.mixed_text(F.col("text"), F.col("__mix_size"), F.col("__mix_taken"), F.col("__mix_spans")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests; null is the empty text."""
    ship(spark)
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("bpe", encode)]

#: Compression, min-wise hashing and BPE have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`. Of what they write only the last stage's input is left at the end."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark):
        for n, (name, stage) in enumerate(STAGES[:-1], start=2):
            with scope(spark):
                docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outer=2 if n == len(STAGES) else 1)
    return STAGES[-1][1](spark, docs, sf_dir)
