"""Before-and-after examples and the cleaning report's totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally import fixed
from tally.operators.audit import Rule
from tally.session import literal_rows

# What each rule does, for one sentence of a summary.
RULE_TEXT = {
    "canonicalise_code": "mapped spelling variants of a code to one value",
    "parse_dates": "brought mixed date formats to one ISO form",
    "drop_exact_duplicates": "dropped rows that were exact copies",
    "parse_year_level": "reduced 'Year 9' and 9 to one number",
    "recode_sentinels": "turned 'no score' numbers into nulls",
    "strip_junk_characters": "took stray characters out of names",
    "coerce_numeric": "nulled text found in number columns",
    "normalise_id": "gave identifiers one form so feeds join",
    "repair_mojibake": "repaired names with a broken encoding",
    "blank_placeholders": "replaced placeholder words by nulls",
    "zero_refused_scores": "zeroed scores of refused tests",
}


def changed_pairs(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Distinct ``(position, rule, before, after)`` over one scan for all rules.

    A value that became null is a change and reads ``(null)``.
    """

    def pair(i: int, rule: Rule) -> Column:
        before = F.col(rule.source or rule.column)
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.detail).alias("explanation"),
            before.cast("string").alias("before"),
            rule.fn(before).cast("string").alias("after"),
        )

    rows = df.select(F.inline(F.array(*[pair(i, r) for i, r in enumerate(rules)])))
    changed = rows.filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))
    return changed.withColumn("after", F.coalesce("after", F.lit("(null)"))).distinct()


def before_after(df: DataFrame, rules: Sequence[Rule], limit: int = 5) -> DataFrame:
    """The first few examples per rule; a rule without examples is absent."""
    order = Window.partitionBy("position", "rule", "explanation").orderBy("before", "after")
    ranked = changed_pairs(df, rules).withColumn("example", F.row_number().over(order))
    return ranked.filter(F.col("example") <= limit)


def refused_but_attempted(
    results: DataFrame,
    participation: DataFrame,
    score: str = "raw_score",
    key: str = "student_id",
    code: str = "participation_code",
    limit: int | None = 5,
) -> DataFrame:
    """Refused tests that carry a score, next to the score they should have."""
    refused = participation.filter(F.col(code) == "R").select(F.col(key).alias("__id"), F.col("domain").alias("__domain")).distinct()
    scored = results.filter(F.col(score).isNotNull() & ~F.col(score).cast("string").isin(*fixed.SENTINELS))
    same = scored[key].eqNullSafe(refused["__id"]) & scored["domain"].eqNullSafe(refused["__domain"])
    met = scored.join(refused, same, "left_semi").select(
        key, "domain", F.col(score).alias("score_in_results")
    )
    rows = met.distinct().withColumns(
        {"participation_code": F.lit("R (refused)"), "corrected_score": F.lit("0")}
    )
    return rows.orderBy(key, "domain", "score_in_results").limit(limit) if limit else rows


def rule_totals(report: DataFrame) -> DataFrame:
    """Values changed per rule, most first, rules without a change left out."""
    totals = report.groupBy("rule").agg(F.sum("changed").alias("changed")).filter("changed > 0")
    return totals.orderBy(F.desc("changed"), "rule")


def rule_total_lines(report: DataFrame) -> DataFrame:
    """The totals as text lines, the grand total last."""
    rolled = report.rollup("rule").agg(F.sum("changed").alias("changed"), F.grouping("rule").alias("g"))
    name = F.when(F.col("g") == 1, F.lit("total values changed")).otherwise(F.col("rule"))
    shown = rolled.filter((F.col("changed") > 0) | (F.col("g") == 1))
    line = F.concat(name, F.lit(": "), F.format_number("changed", 0))
    return shown.orderBy("g", F.desc("changed"), "rule").select(line.alias("line"))


def rule_tiles(report: DataFrame, highlights: dict[str, str] = fixed.HEADLINE_RULES) -> DataFrame:
    """One tile per listed rule, zero where the rule changed nothing."""
    tiles = [(i, rule, label) for i, (rule, label) in enumerate(highlights.items(), 1)]
    wanted = literal_rows(report.sparkSession, ("position", "rule", "label"), tiles)
    totals = report.groupBy("rule").agg(F.sum("changed").alias("changed"))
    return wanted.join(totals, "rule", "left").select(
        F.col("position").cast("bigint").alias("position"), "rule", "label", F.coalesce("changed", F.lit(0)).cast("bigint").alias("changed")
    )


def report_summary(report: DataFrame) -> DataFrame:
    """One paragraph grounded in the counts, with the leading rule's own text."""
    totals = report.groupBy("rule").agg(F.sum("changed").alias("changed"))

    def of(rule: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rule") == rule, F.col("changed"))), F.lit(0))

    one = totals.agg(
        F.coalesce(F.sum("changed"), F.lit(0)).alias("total"),
        F.min_by("rule", F.struct(-F.col("changed"), F.col("rule"))).alias("top_rule"),
        F.max("changed").alias("top_n"),
        of("recode_sentinels").alias("sentinels"),
        of("zero_refused_scores").alias("refused"),
    )
    texts = F.create_map(*[F.lit(x) for item in RULE_TEXT.items() for x in item])
    other = F.concat(F.lit("applied the rule "), F.replace("top_rule", F.lit("_"), F.lit(" ")))
    top = F.coalesce(F.try_element_at(texts, F.col("top_rule")), other)
    sentence = F.format_string(
        "%s values were changed. The largest group (%s) %s. %s 'no score' numbers were kept out of every "
        "average and %s refused tests had their score set to zero. Each change belongs to a named rule.",
        F.format_number("total", 0),
        F.format_number("top_n", 0),
        top,
        F.format_number("sentinels", 0),
        F.format_number("refused", 0),
    )
    return one.withColumn("summary", sentence)
