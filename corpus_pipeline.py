"""From raw documents to packed training sequences, in five stages.

run(spark, sf_dir) applies STAGES to the table documents. Each stage takes all that its predecessor kept; all but
the last return the columns of documents. Stages write to the shared checkpoint folder in between, so a lost
executor costs a stage's work at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import checkpointed, table
from pairloom.llm.mixing import in_mix_order
from pairloom.llm.packing import packed_in_order
from pairloom.llm.quality import accepted
from pairloom.llm.simhash import one_of_near_copies
from pairloom.llm.suffix import cleaned


#: Consecutive documents of the mix that are packed together.
STRETCH = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 and more)."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8, found by SimHash) the document of the smallest id."""
    return one_of_near_copies(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that also start earlier."""
    return cleaned(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their place in the mix of sources; files read in order are the mix."""
    return in_mix_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens; read by ascending sequence_id these follow the order of docs."""
    return packed_in_order(docs, public_tokenizers.path("word_bpe_49k.json"), stretch=STRETCH)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


#: A classifier, a graph's components and bin packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
