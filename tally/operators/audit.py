"""Named cleaning rules that carry their own counters.

A rule adds its cleaned column and a hidden flag per counter. The flags ride
along in the same projection, so the clean table and the audit come from one
plan: selecting the clean columns lets Catalyst drop the flags, and one aggregate
over the flags gives the whole report. No rule triggers a job of its own.

Counters are aggregated from rows, not collected as run-time metrics: a stage
that is run again after a lost executor would add to a metric twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.session import stage

Counter = Callable[[Column, Column], Column]

REPORT_SCHEMA = "rule string, column string, changed bigint, detail string"


def differs(before: Column, after: Column) -> Column:
    """Null-safe change of the value as text."""
    return ~before.cast("string").eqNullSafe(after.cast("string"))


def lost(before: Column, after: Column) -> Column:
    """A value that was there and is null now."""
    return before.isNotNull() & after.isNull()


def present(before: Column, after: Column) -> Column:
    """A value that is there now."""
    return after.isNotNull()


@dataclass(frozen=True)
class Rule:
    """One cleaning rule on one column.

    ``detail`` may hold ``{}``; ``detail_count`` then fills it, and a count of
    zero leaves only the text before the first ``;``.
    """

    name: str
    column: str
    fn: Callable[[Column], Column]
    source: str | None = None
    counter: Counter = differs
    detail: str = ""
    detail_count: Counter | None = None
    label: str | None = None


@dataclass
class Audited:
    """A cleaned frame with its hidden counters."""

    df: DataFrame
    rules: Sequence[Rule]
    columns: Sequence[str]

    @property
    def flags(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def clean(self) -> DataFrame:
        return self.df.select(*self.columns)

    def report(self) -> DataFrame:
        return rule_report(self.df, self.rules)


def _flag(i: int, kind: str) -> str:
    return f"__{kind}_{i}"


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> Audited:
    """Run the rules in order, keeping a flag column per counter."""
    for i, rule in enumerate(rules):
        before = F.col(rule.source or rule.column)
        after = rule.fn(before)
        new = {rule.column: after, _flag(i, "changed"): rule.counter(before, after)}
        if rule.detail_count is not None:
            new[_flag(i, "detail")] = rule.detail_count(before, after)
        df = df.withColumns(new)
    return Audited(df, rules, [c for c in df.columns if not c.startswith("__")])


def rule_report(df: DataFrame, rules: Sequence[Rule], summed: bool = False) -> DataFrame:
    """One aggregate over all counters, one output row per rule.

    ``summed`` says that the flags were already counted per distinct row.
    """
    flags = [_flag(i, "changed") for i in range(len(rules))]
    flags += [_flag(i, "detail") for i, rule in enumerate(rules) if rule.detail_count is not None]
    if summed:
        totals = df.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags])
    else:
        totals = df.agg(*[F.count_if(f).alias(f) for f in flags])
    rows = []
    for i, rule in enumerate(rules):
        detail = F.lit(rule.detail)
        if rule.detail_count is not None:
            n = F.col(_flag(i, "detail"))
            filled = F.replace(detail, F.lit("{}"), n.cast("string"))
            bare = F.lit(rule.detail.split(";")[0]) if ";" in rule.detail else filled
            detail = F.when(n > 0, filled).otherwise(bare)
        rows.append(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.label or rule.column).alias("column"),
                F.col(_flag(i, "changed")).alias("changed"),
                detail.alias("detail"),
            )
        )
    return totals.select(F.inline(F.array(*rows)))


def count_row(df: DataFrame, rule: str, column: str, changed: Column, detail: str = "") -> DataFrame:
    """A one-row report from an aggregate expression over ``df``."""
    return df.agg(F.coalesce(changed, F.lit(0)).cast("bigint").alias("changed")).select(
        F.lit(rule).alias("rule"), F.lit(column).alias("column"), "changed", F.lit(detail).alias("detail")
    )


def report_rows(df: DataFrame, *rows: tuple[str, str, Column, str]) -> DataFrame:
    """Report rows ``(rule, column, changed, detail)`` made from the columns of a one-row frame."""
    made = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column"),
            F.coalesce(changed, F.lit(0)).cast("bigint").alias("changed"),
            F.lit(detail).alias("detail"),
        )
        for rule, column, changed, detail in rows
    ]
    return df.select(F.inline(F.array(*made)))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def with_total(report: DataFrame) -> DataFrame:
    """The report and a closing row with the number of values changed.

    The few report rows are written first, so the total does not count again.
    """
    report = stage(report, "report")
    total = count_row(report, "total values changed", "", F.sum("changed"))
    return report.unionByName(total)


def summary_lines(report: DataFrame) -> DataFrame:
    """The report as text, one line per rule and column, the total last."""
    label = F.when(F.col("column") == "", F.col("rule")).otherwise(F.concat("rule", F.lit(" ("), "column", F.lit(")")))
    tail = F.when(F.col("detail") == "", F.lit("")).otherwise(F.concat(F.lit("  - "), "detail"))
    last = F.col("column") == ""
    line = F.format_string("%-44s %10s%s", label, F.format_number("changed", 0), tail)
    return with_total(report).orderBy(last, "rule", "column").select(line.alias("line"))
