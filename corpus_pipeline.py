"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go, then those of low quality, then all but one of each group of near duplicates; what is left is mixed
to the sources' target weights in curriculum order, and encoded. Every stage works on all that its predecessor kept and
learns from the labels of those documents. A mixed document stands once for each pass that takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspan.llm import curriculum, ngram_join, pieces, quality, toxicity
from inkspan.llm.common import stage
from inkspan.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_best(docs, pieces.Model.load(tokenizer(spark, "piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: Language models, networks and segmentation have no SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
