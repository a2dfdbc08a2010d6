"""Data dictionary and source inventory."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.session import literal_rows

# Meaning of the clean tables' columns.
COLUMN_NOTES = {
    "student_id": "student identifier, one form across feeds",
    "enrolment_id": "local enrolment number without leading zeros",
    "year_level": "school year: 3, 5, 7 or 9",
    "school_id": "school identifier",
    "family_name": "family name, encoding repaired, stray characters removed",
    "given_name": "given name, placeholders nulled",
    "middle_name": "middle name, often missing",
    "gender": "M, F or X",
    "birth_date": "birth date as ISO text",
    "domain": "Reading, Numeracy, Spelling, Grammar and Punctuation or Writing",
    "raw_score": "sum of marks, null without a test",
    "scaled_score": "score on the reporting scale, 0 for a refusal",
    "proficiency": "band as delivered",
    "test_year": "year of the test",
    "participation_code": "P, A, E, W, R or X",
    "school_name": "school name",
    "sector": "school sector",
    "postcode": "four digits",
}


def annotate(df: DataFrame, notes: Mapping[str, str] = COLUMN_NOTES) -> DataFrame:
    """Attach notes as column comments, which table formats keep."""
    return df.select([F.col(c).alias(c, metadata={"comment": notes.get(c, "")}) for c in df.columns])


def data_dictionary(tables: Mapping[str, DataFrame], notes: Mapping[str, str] = COLUMN_NOTES) -> DataFrame:
    """One row per column: table, column, type, description, rows of the table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.metadata.get("comment") or notes.get(f.name, ""))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    columns = literal_rows(spark, ("table", "position", "column", "type", "description"), rows)
    columns = columns.withColumn("position", F.col("position").cast("bigint"))
    return columns.join(_row_counts(tables), "table", "left")


def _row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def dictionary_markdown(dictionary: DataFrame) -> DataFrame:
    """The dictionary as one markdown section per table, ready to write as text."""
    line = F.concat(F.lit("| `"), "column", F.lit("` | "), "type", F.lit(" | "), "description", F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    head = F.concat(
        F.lit("## `"), "table", F.lit("` ("), F.format_number("n_rows", 0),
        F.lit(" rows)\n\n| column | type | description |\n|---|---|---|\n"),
    )
    per_table = dictionary.groupBy("table", "n_rows").agg(F.array_join(lines, "\n").alias("body"))
    return per_table.select(F.concat(head, "body", F.lit("\n")).alias("section"))


def write_dictionary(tables: Mapping[str, DataFrame], path: str, notes: Mapping[str, str] = COLUMN_NOTES) -> str:
    """Write the markdown sections as text, replacing what was there."""
    dictionary_markdown(data_dictionary(tables, notes)).write.mode("overwrite").text(path)
    return path


def source_inventory(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Files, rows, columns and bytes per source, and a total row.

    File names and sizes come from the scan's own metadata; rows are counted per file without reading a
    data column, each source is scanned once, and the total is the roll-up of the same rows.
    """
    parts = [
        df.select(
            F.lit(name).alias("source"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b"),
            F.lit(len(df.columns)).cast("bigint").alias("k"),
        )
        for name, df in sources.items()
    ]
    per_file = reduce(DataFrame.unionAll, parts).groupBy("source", "p", "b", "k").agg(F.count("*").alias("n"))
    total = F.grouping("source") == 1
    return per_file.rollup("source").agg(
        total.alias("all"), F.count("*").alias("n_files"), F.sum("n").alias("n_rows"),
        F.when(~total, F.max("k")).alias("n_columns"), F.sum("b").alias("n_bytes"),
    ).select(F.when(F.col("all"), F.lit("total")).otherwise(F.col("source")).alias("source"), "n_files", "n_rows", "n_columns", "n_bytes")
