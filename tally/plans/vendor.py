"""Vendor answer files to long scores, and their reconciliation."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally import fixed
from tally.operators import irt, markers, reshape
from tally.session import stage
from tally.sources.files import answer_schema, csv_header, scan_many, scan_typed_csv


def read_vendor(spark: SparkSession, raw_dir: str) -> dict[str, dict]:
    """Paper files by year level and writing files by scope."""

    def scan(name: str) -> DataFrame:
        path = os.path.join(raw_dir, name)
        return scan_typed_csv(spark, path, answer_schema(csv_header(spark, path)))

    return {
        "paper": {y: scan(f"vendor_y{y}.csv") for y in fixed.YEAR_LEVELS},
        "writing": {s: scan(f"vendor_writing_{s}.csv") for s in ("y3", "y579")},
    }


def vendor_parts(paper: Mapping[int, DataFrame], writing: Mapping[str, DataFrame]) -> DataFrame:
    """All files as ``(PlatformId, domain, raw_score, file)``; ``file`` counts them in the order given, paper first.

    Item headers carry the year level, so each file is reshaped before the union.
    """
    parts = [reshape.reshape_paper(df) for df in paper.values()]
    parts += [reshape.reshape_writing(df) for df in writing.values()]
    return scan_many(p.withColumn("file", F.lit(i)) for i, p in enumerate(parts))


def first_file_wins(parts: DataFrame) -> DataFrame:
    """One score per student and domain: where several files have it, that of the first file."""
    first = F.min(F.struct("file", "raw_score")).alias("first")
    return parts.groupBy("PlatformId", "domain").agg(first).select("PlatformId", "domain", F.col("first.raw_score").alias("raw_score"))


def vendor_scores(paper: Mapping[int, DataFrame], writing: Mapping[str, DataFrame]) -> DataFrame:
    """All files as ``(PlatformId, domain, raw_score)``, the first file's score where a student stands in two."""
    return first_file_wins(vendor_parts(paper, writing))


def vendor_conflicts(parts: DataFrame) -> DataFrame:
    """One report row: pairs that stand in several files with different scores, of which the first file's was taken."""
    per_pair = parts.groupBy("PlatformId", "domain").agg((F.min("raw_score") != F.max("raw_score")).alias("differ"))
    found = per_pair.agg(F.coalesce(F.count_if("differ"), F.lit(0)).alias("changed"))
    return found.select(
        F.lit("vendor_scores.first_file").alias("rule"), F.lit("PlatformId").alias("column"), "changed",
        F.lit("different scores in several files, first file kept").alias("detail"),
    )


def reconcile_vendor(vendor: DataFrame, results: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Mismatched pairs and the summary that an empty mismatch list rests on."""
    return (
        reshape.reconcile(vendor, results, tolerance=tolerance),
        reshape.reconcile_summary(vendor, results, tolerance=tolerance),
    )


def fit_paper(paper: Mapping[int, DataFrame], id_column: str = "PlatformId", form: str = "grouped") -> dict[str, DataFrame]:
    """All level-by-domain fits in one job: items, statistics, abilities. ``form`` as in ``irt.fit_groups``."""
    segments = ["year_level", "domain"]
    answers = stage(
        scan_many(
            irt.domain_answers(df, id_column).withColumn("year_level", F.lit(level).cast("bigint"))
            for level, df in paper.items()
        ),
        "answers",
        narrow=True,
    )
    headers = {(y, d): reshape.item_columns(df, d) for y, df in paper.items() for d in fixed.ITEM_BLOCKS}
    labels = F.lit(None).cast("array<string>")
    for (level, domain), columns in headers.items():
        here = (F.col("year_level") == level) & (F.col("domain") == domain)
        labels = F.when(here, F.array(*[F.lit(c) for c in columns])).otherwise(labels)
    patterns = stage(irt.response_patterns(answers, segments), "patterns")
    fits = irt.fit_groups(patterns, segments, form)
    known = irt.pattern_abilities(patterns, fits, segments)
    return {
        "items": irt.item_parameters(fits, labels, segments),
        "statistics": irt.fit_statistics(fits, segments),
        "abilities": irt.person_abilities(answers, known, id_column, segments),
    }


def review_markers(writing: Mapping[str, DataFrame], results: DataFrame) -> DataFrame:
    """Marker review queue from the writing files and the clean results."""
    one_each = reshape.first_per_key(scan_many(writing.values()), "PlatformId")
    criteria = [F.coalesce(F.col(c), F.lit(0)) for c in fixed.WRITING_CRITERIA if c in one_each.columns]
    scripts = one_each.select("PlatformId", "marker_id", sum(criteria, F.lit(0)).alias("writing_raw"))
    ability = markers.other_ability(results)
    joined = scripts.join(ability, scripts["PlatformId"] == ability["student_id"])
    return markers.marker_review(joined, "marker_id", "writing_raw", "other_ability")
