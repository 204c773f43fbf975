"""The training-data pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import hostrules, neardup, repeats, tokens, toxicity
from evidentia.llm._common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host is closed, go; so do null and empty texts. Equal rows go alike."""
    return hostrules.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; labels are learnt through the documents that are left. Equal texts go alike; without labels none goes."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 on five-word shingles), that of the least doc_id, stays; texts without words all stay."""
    return neardup.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat from documents of a smaller doc_id are cut out; a document that is left empty stays."""
    return repeats.remove_repeats(docs, with_text=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts, whole, as pieces of token sequences; an empty or null one is its end id."""
    return tokens.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packing),
]

#: Language models, suffix arrays and tokenizers are beyond SQL; the operators are tested against plain versions, and the stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
