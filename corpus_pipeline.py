"""A training corpus from raw documents: known language, one document of each near-duplicate group, no repeated passages, mixed by source, packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.bwt import without_repeats
from siftlake.llm.langid import keep_identified, learn_text_model
from siftlake.llm.mixing import mixed
from siftlake.llm.packing import pack_documents
from siftlake.llm.shared import shared_dir
from siftlake.llm.sigtree import first_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.  The text model is learned from these documents' own ``lang``; without any, all stay."""
    return keep_identified(docs, learn_text_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of 0.8 connect, and every document without words or id."""
    return first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat one with a smaller id; a document of which nothing is left goes."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048; a null text is one end id, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing sources", source_mix), ("best-fit packing", packing)]

#: Tokenizer ids and random rounding are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
