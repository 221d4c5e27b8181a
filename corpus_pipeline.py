"""A corpus pipeline: filter, deduplicate, decontaminate and mix documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.  For all
stages: further columns stay as they are, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hierql.llm import decontaminate, language_id, mixing, ngram_join, toxicity
from hierql.llm.common import materialize, remove_materialized, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts have the score of a text without a known feature, which
    is low: they stay.  Rows with a null id are scored, not learned from; equal
    texts stay or go together.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, prefix="hq_").where("hq_predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages.

    Null texts, those without a letter and those whose cross-entropy lies beyond
    their language's bound go; so does everything if no row has a language.
    """
    found = language_id.identify(docs, language_id.fit(docs), prefix="hq_")
    return found.where("NOT hq_rejected").select(*[f"`{c}`" for c in docs.columns])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id.

    Texts without a word and rows with a null id are near nothing and stay; of
    rows with equal ids, each stays or goes by its text, equal rows once.
    """
    return ngram_join.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with their ``size`` and the words that the mix takes of them, ``taken``.

    Documents without a word, or behind the end of their source's service, are
    no part of it; a null source is a source; columns with these two names are replaced.
    """
    docs = docs.drop("size", "taken")
    return mixing.fair_mix(docs).withColumnsRenamed({"mix_size": "size", "mix_taken": "taken"})


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each_class),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Two stages score texts with models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; what a stage leaves behind is deleted."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove_materialized(spark, since=start, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
