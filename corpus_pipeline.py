"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Edge cases, as the operators define them: documents of null or empty text, or without a letter, go at the first stage;
of equal rows and near copies the smallest doc_id stays; a document left without a word by the fourth stage goes; rows without a
doc_id pass the first four stages and are packed; null lang, source and n_chars pass through; extra columns pass through all stages
but the last; an empty table gives an empty result.

A stage's own tables in the shared folder are deleted when the next stage of the same pipeline begins (the same thread and folder), which reads
what that stage has returned and not those.
"""
import functools
import threading
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import language, near_dup, packing, quality_rules, substring_dedup
from evigraph.llm.common import recorded, remove, shared_dir, table


#: What the last stage of a pipeline has left, by the thread that runs it and the folder it runs over.
_left: dict[tuple[int, str], list[str]] = {}


def stage(function):
    """A stage that begins by deleting what the stage before it has left."""

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = threading.get_ident(), sf_dir
        remove(spark, _left.pop(own, []))
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _left[own] = paths
        return out

    return staged


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; those that its models reject go."""
    return language.keep_languages(docs, language.fit_languages(docs))


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a posterior probability of a half at least."""
    return quality_rules.keep_quality(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each class of near-duplicates."""
    return near_dup.keep_one_of_each(docs)


@stage
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return substring_dedup.drop_passages(docs, substring_dedup.repeated_passages(docs))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in as few sequences as minimum bin slack finds."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring), ("packing", pack)]

#: SQL can express neither the models nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{shared_dir(spark)}/evigraph/pipeline-{name}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.select(*[F.col(c) for c in docs.columns])


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
