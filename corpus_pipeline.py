"""From `documents` to token files: the stages, and a run of all of them."""

from pyspark.sql import DataFrame, SparkSession

from omenflow.llm import decontaminate, mixing, near_copies, queries, token_files, toxicity
from omenflow.operators.durable import written


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8; SimHash, then an exact index), that with the smallest id."""
    return near_copies.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a test item stands."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; where each lies in them, and a checksum of its ids."""
    return token_files.token_digest(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed_sources),
    ("token_output", tokens),
]
#: A trained classifier and a tokenizer are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
