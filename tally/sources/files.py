"""Scans and sinks."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally import fixed
from tally.operators.reshape import header_domain

# Under the root of the clean tables: a folder for each load, and what names the tables in use.
LOADS = "loads"
MANIFESTS = "manifests"

# Quotes are doubled inside quoted text and blanks are data, on both sides.
_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def scan_text_csv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """All-string scan with missing-value tokens nulled.

    With ``columns`` no file is touched before the job runs, and a file whose
    header disagrees fails instead of shifting values.
    """
    reader = spark.read.options(**_CSV, multiLine=multiline)
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path)
    return df.select([null_tokens(F.col(c)).alias(c) for c in df.columns])


def null_tokens(c: Column, tokens: Iterable[str] = fixed.NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def answer_schema(header: Sequence[str]) -> T.StructType:
    """Types of a vendor feed from its header: marks and levels whole, rest text."""
    whole = {"Ylevel": T.LongType(), "LocalId": T.LongType()}
    marks = {c: T.LongType() for c in header if header_domain(c) or c in fixed.WRITING_CRITERIA}
    types = whole | marks
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])


def scan_typed_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Scan with a declared schema, no inference pass."""
    return spark.read.options(**_CSV, enforceSchema=False).schema(schema).csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV source (reads its first line only)."""
    return spark.read.options(**_CSV).csv(path).columns


def scan_many(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name; a missing column reads null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**_CSV).csv(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write every table under ``root`` beside what is there, then let readers see all of them at once.

    Each load has a folder of its own; a manifest, one small file that appears as a whole once all
    tables are written, names where each table lies. A load that fails leaves the old manifest, and
    readers of the old tables keep their files. One load at a time writes to a root.
    """
    load = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(os.path.join(root, LOADS, load, name))
    spark = next(iter(tables.values())).sparkSession
    lies = table_folders(spark, root) | {name: f"{LOADS}/{load}/{name}" for name in tables}
    line = spark.range(1).select(F.lit(json.dumps(lies)).alias("value")).coalesce(1)
    line.write.text(os.path.join(root, MANIFESTS, load))
    return root


def table_folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The newest manifest under ``root``: table to folder; empty where none has been written."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(os.path.join(root, MANIFESTS))
        newest = lines.orderBy(F.desc("_metadata.file_path")).first()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads(newest["value"]) if newest else {}


def table_path(spark: SparkSession, root: str, name: str) -> str:
    return os.path.join(root, table_folders(spark, root).get(name, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(spark, root, name))


def replace_partitions(df: DataFrame, root: str, name: str, by: Sequence[str]) -> str:
    """Replace those partitions of a table that ``df`` has rows for; all others stay as they are."""
    path = table_path(df.sparkSession, root, name)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make frames queryable by name in their own session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def unregister(spark: SparkSession, names: Iterable[str]) -> None:
    for name in names:
        spark.catalog.dropTempView(name)
