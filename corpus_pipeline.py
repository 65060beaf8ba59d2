"""A corpus pipeline over ``documents``: five operators of ``agroseries.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it as the next stage's documents.

1. Language ID: texts that are rejected go.
2. N-gram Jaccard join: one document of each component stays.
3. Suffix-array dedup: bytes covered by 50-byte strings of earlier documents go, in
   whole characters.
4. Benchmark decontamination: documents with a passage of a benchmark item go.
5. Byte-level BPE: ids of every text, and whether decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroseries.llm import blocks, bpe, decontam, jaccard, langid, suffix
from agroseries.session import scratch_path

ORACLE_SQL = None  # language models, components and byte strings are tested against brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blocks.ship(spark)
    return docs.where(langid.predict(docs, langid.fit(docs))["accepted"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blocks.ship(spark)
    return jaccard.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blocks.ship(spark)
    out = suffix.remove_repeats(docs, characters=True)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blocks.ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    blocks.ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = docs.withColumn("made", bpe.encode_checked(F.col("text"), path, public_tokenizers.PATTERN))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("made.ids").cast("long").alias("n_tokens"), "made.ids", "made.round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
