"""From raw documents to tokens in five stages, each written as Parquet and read by the next.

Toxic documents go; lines that recur across documents go; one document of each group of near
copies (five-word shingles, similarity 0.8) stays; sources are mixed to target weights, a document
as often as it is taken; the mixture is tokenized and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, line_dedup, mixing, ngram_join, scratch, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: The stages rest on trained weights, a reduction tree of random draws and a tokenizer; SQL has none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's tables are deleted once the next one has been written.

    The result reads the table of the stage before it, which stays in the shared folder.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        at = scratch.mark() - len(before)
        with scratch.temporary(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), "stage")
        scratch.release(spark, before)
        before = scratch.since(at)
    return STAGES[-1][1](spark, docs, sf_dir)
