"""Wide answer sheets to long scores, and the proof that the result is right."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.values import recode_not_attempted
from tally.operators.audit import count_row, report_rows
from tally.operators.rows import first_per_key
from tally.session import stage


def header_domain(header: str) -> str | None:
    """Domain of an item header, null for anything else."""
    match = re.match(fixed.ITEM_HEADER, header)
    if match is None:
        return None
    question = int(match[3])
    for domain, (prefix, first, last) in fixed.ITEM_BLOCKS.items():
        if match[1] == prefix and question >= first and (last is None or question <= last):
            return domain
    return None


def domain_of(header: Column) -> Column:
    """The same for headers that arrive as data."""
    prefix = F.regexp_extract(header, fixed.ITEM_HEADER, 1)
    question = F.nullif(F.regexp_extract(header, fixed.ITEM_HEADER, 3), F.lit("")).try_cast("bigint")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for domain, (letter, first, last) in fixed.ITEM_BLOCKS.items():
        inside = (prefix == letter) & (question >= first)
        out = out.when(inside if last is None else inside & (question <= last), F.lit(domain))
    return out


def item_columns(df: DataFrame, domain: str | None = None) -> list[str]:
    """Item columns present in a feed, optionally of one domain."""
    found = {c: header_domain(c) for c in df.columns}
    return [c for c, d in found.items() if d is not None and domain in (None, d)]


def recode_items(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Not-attempted marks to zero in the item columns only."""
    columns = columns or item_columns(df)
    return df.withColumns({c: recode_not_attempted(F.col(c)) for c in columns})


def unpivot_items(df: DataFrame, id_column: str) -> DataFrame:
    """One row per student and item, with the item's domain.

    The headers are known here, so the domain is a lookup, not a parse per row.
    """
    items = item_columns(df)
    domains = F.create_map(*[F.lit(x) for c in items for x in (c, header_domain(c))])
    return df.unpivot([id_column], items, "item", "mark").withColumn("domain", domains[F.col("item")])


def _row_sum(columns: Sequence[str], recode: bool) -> Column:
    marks = [F.col(c).cast("bigint") for c in columns]
    marks = [recode_not_attempted(m) if recode else m for m in marks]
    return reduce(add, [F.coalesce(m, F.lit(0)) for m in marks])


def reshape_paper(df: DataFrame, id_column: str = "PlatformId") -> DataFrame:
    """Wide items to ``(id, domain, raw_score)``.

    Headers fix each column's domain before the job runs and one row per student
    is left after the re-delivered copies go, so a domain's total is a sum inside
    the row. That replaces the per-item rows and the second shuffle of an
    unpivot-and-group plan; both give the same scores.
    """
    one_each = first_per_key(df.filter(F.col(id_column).isNotNull()), id_column)
    parts = [
        F.struct(F.lit(domain).alias("domain"), _row_sum(columns, recode=True).alias("raw_score"))
        for domain in fixed.ITEM_BLOCKS
        if (columns := item_columns(df, domain))
    ]
    return one_each.select(id_column, F.inline(F.array(*parts)))


def reshape_writing(
    df: DataFrame, id_column: str = "PlatformId", criteria: Sequence[str] = fixed.WRITING_CRITERIA
) -> DataFrame:
    """Criterion marks to ``(id, 'Writing', raw_score)``; absent criteria are skipped."""
    known = [c for c in criteria if c in df.columns]
    one_each = first_per_key(df.filter(F.col(id_column).isNotNull()), id_column)
    return one_each.select(id_column, F.lit("Writing").alias("domain"), _row_sum(known, recode=False).alias("raw_score"))


def paper_report(df: DataFrame, id_column: str = "PlatformId") -> DataFrame:
    """Report rows of ``reshape_paper``: copies dropped, marks recoded, rows made.

    The row kept of each id carries how many rows the id had, so one pass gives all three.
    """
    items = item_columns(df)
    nines = reduce(add, [F.when(F.col(c) == fixed.NOT_ATTEMPTED, 1).otherwise(0) for c in items])
    n_domains = len({header_domain(c) for c in items})
    # The row that first_per_key keeps: the least in all other columns, nulls last.
    order = [x for c in df.columns if c != id_column for x in (F.col(c).isNull(), F.col(c))]
    per_id = df.select(id_column, F.struct(*order, nines.alias("nines")).alias("row")).groupBy(id_column)
    one = per_id.agg((F.count("*") - 1).alias("extra"), F.min("row")["nines"].alias("nines")).agg(
        F.sum("extra").alias("extra"), F.sum("nines").alias("nines"), F.count(id_column).alias("ids")
    )
    return report_rows(
        one,
        ("reshape_paper.dedup", id_column, F.col("extra"), "duplicate student rows"),
        ("reshape_paper.recode_sentinel", "vendor items", F.col("nines"), "9 -> 0"),
        ("reshape_paper.melt", "vendor", F.col("ids") * n_domains, "wide -> long"),
    )


def criteria_report(df: DataFrame, id_column: str = "PlatformId") -> DataFrame:
    """Report row of ``reshape_writing``: rows made, one for each id."""
    ids = df.filter(F.col(id_column).isNotNull()).select(id_column).distinct()
    return count_row(ids, "reshape_writing", "criteria", F.count("*"), "criterion sum")


def pivot_wide(df: DataFrame, id_column: str, domains: Sequence[str], value: str = "raw_score") -> DataFrame:
    """One row per id, one column per listed domain."""
    return df.groupBy(id_column).agg(*[F.max(F.when(F.col("domain") == d, F.col(value))).alias(d) for d in domains])


def response_matrix(df: DataFrame, id_column: str, domain: str) -> DataFrame:
    """One row per student with the domain's 0/1 marks."""
    items = item_columns(df, domain)
    return recode_items(first_per_key(df, id_column).select(id_column, *items), items)


def zero_refused(
    results: DataFrame,
    participation: DataFrame,
    results_key: str = "student_id",
    part_key: str = "student_id",
    scores: Sequence[str] = ("raw_score", "scaled_score"),
    code: str = "participation_code",
) -> DataFrame:
    """Zero the scores of a refusal. Adds ``refused`` and ``overridden`` flags.

    The refused set is distinct before the join, so no result row is repeated.
    """
    refused = (
        participation.filter(F.col(code) == "R")
        .select(F.col(part_key).alias("__id"), F.col("domain").alias("__domain"))
        .distinct()
        .withColumn("__refused", F.lit(True))
    )
    met = results[results_key].eqNullSafe(refused["__id"]) & results["domain"].eqNullSafe(refused["__domain"])
    joined = results.join(refused, met, "left")
    hit = F.coalesce(F.col("__refused"), F.lit(False))
    first = results[scores[0]]
    return joined.select(
        *[
            F.when(hit, F.lit(0).cast(results.schema[c].dataType)).otherwise(results[c]).alias(c)
            if c in scores
            else results[c]
            for c in results.columns
        ],
        hit.alias("refused"),
        (hit & (F.coalesce(first, F.lit(0)) != 0)).alias("overridden"),
    )


def refused_report(overridden: DataFrame) -> DataFrame:
    return count_row(
        overridden, "zero_refused_scores", "raw_score", F.count_if("overridden"), "R overrides score -> 0"
    )


def reconcile(
    vendor_long: DataFrame,
    warehouse: DataFrame,
    vendor_id: str = "PlatformId",
    warehouse_id: str = "student_id",
    tolerance: float = 0.0,
) -> DataFrame:
    """Pairs whose two totals differ by more than the tolerance. Empty is proof."""
    v, w = _totals(vendor_long, warehouse, vendor_id, warehouse_id)
    v, w = stage(v, "vendor_totals", narrow=True), stage(w, "warehouse_totals", narrow=True)
    gap = F.abs(F.col("raw_score_vendor") - F.col("raw_score_warehouse"))
    return v.join(w, [vendor_id, "domain"]).filter(gap > tolerance)


def reconcile_summary(
    vendor_long: DataFrame,
    warehouse: DataFrame,
    vendor_id: str = "PlatformId",
    warehouse_id: str = "student_id",
    tolerance: float = 0.0,
) -> DataFrame:
    """Matched, mismatched and one-sided rows: what an inner join alone hides.

    Equal totals of a pair are counted before the two sides meet, so repeated
    rows of one pair never travel as rows. Each step is a narrow stage of its own,
    so that no task sorts for two of them.
    """
    v, w = _totals(vendor_long, warehouse, vendor_id, warehouse_id)
    v = stage(v.groupBy(*v.columns).agg(F.count("*").alias("nv")), "vendor_totals", narrow=True)
    w = stage(w.groupBy(*w.columns).agg(F.count("*").alias("nw")), "warehouse_totals", narrow=True)
    met = v.join(w, [vendor_id, "domain"], "full_outer")
    gap = F.abs(F.col("raw_score_vendor") - F.col("raw_score_warehouse"))
    pairs = F.col("nv") * F.col("nw")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    summary = met.agg(
        total(pairs).alias("compared"),
        total(F.when(gap > tolerance, pairs)).alias("mismatched"),
        total(F.when(F.col("nw").isNull(), F.col("nv"))).alias("vendor_only"),
        total(F.when(F.col("nv").isNull(), F.col("nw"))).alias("warehouse_only"),
    )
    return stage(summary, "reconciled", narrow=True)


def _totals(vendor: DataFrame, warehouse: DataFrame, vendor_id: str, warehouse_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides under common key names, each with its own score column."""
    return (
        vendor.select(vendor_id, "domain", F.col("raw_score").alias("raw_score_vendor")),
        warehouse.select(
            F.col(warehouse_id).alias(vendor_id), "domain", F.col("raw_score").alias("raw_score_warehouse")
        ),
    )
