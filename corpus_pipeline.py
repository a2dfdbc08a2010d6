"""From raw documents to token files, in stages that are each written and read again.

Every stage is one operator of ``tally.llm`` and works on all rows that the stage before kept; all but
the last return the columns of ``documents``. The classifier and the draw of the mix depend on hashes
and on fitted models, which SQL does not express, so there is no ``ORACLE_SQL`` and the tests compare
the stages with plain versions on small tables.

Defined results, stage by stage: null and empty texts pass the classifier as their score says, are in no
group of near duplicates and all stay there, are never contaminated, weigh nothing in the mix, and are
one end id in the token files. Rows equal in id and text are one row from the second stage on; of equal
scores or sizes the hash of the row decides, so reruns agree. Texts of any length stay whole in every
stage. Extra columns, clashing names included, are carried to the last stage, and an empty table gives
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm.common import small_arrow, table
from tally.llm.decontaminate import clean_documents
from tally.llm.jaccard_join import one_of_each
from tally.llm.mixing import mixed_documents
from tally.llm.quality_classifier import good_documents
from tally.llm.registry import query
from tally.llm.token_files import encoded
from tally.session import scratch_path, tune

ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier keeps."""
    return good_documents(docs, table(small_arrow(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_arrow(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is not contaminated by the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each time that a text is taken, always whole."""
    return mixed_documents(docs, whole=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per row of it where its ids stand."""
    small_arrow(spark)
    return encoded(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline")(run)
