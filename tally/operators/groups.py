"""Group comparisons: gaps with intervals, rankings, shrunk means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.inference import t_quantile_of, welch_df
from tally.session import stage

MIN_RELIABLE_N = 30
MIN_BETWEEN_VARIANCE = 1.0


def group_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n``, ``mean`` and ``m2`` (sum of squared deviations) per group.

    These three merge, so a fact table can be reduced by its foreign key first
    and joined to a dimension afterwards.
    """
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count("*")).alias("m2"),
        )
    )


def merge_moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge moments of finer groups into coarser ones.

    Means enter as distances from the mean of all, so that a large common level
    does not swallow the spread.
    """
    df = stage(df, "moments")
    centre = F.coalesce(df.select(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar(), F.lit(0.0))
    off = F.col("mean") - centre
    n, away = F.sum("n"), F.sum(F.col("n") * off) / F.sum("n")
    spread = F.sum(F.col("m2") + F.col("n") * off * off) - n * away * away
    return df.groupBy(*keys).agg(
        n.alias("n"), (centre + away).alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2")
    )


def variance(n: Column, m2: Column) -> Column:
    """Sample variance; null for a single row."""
    return F.when(n > 1, m2 / (n - 1))


def school_moments(
    results: DataFrame, schools: DataFrame, value: str, key: str = "school_id", by: Sequence[str] = ("school_name",)
) -> DataFrame:
    """Moments per school, reduced by id before the schools table is joined.

    ``by`` names the schools columns that identify a group. The name alone merges
    schools that share it; add the id to keep them apart.
    """
    per_id = group_moments(results, [key], value)
    joined = per_id.join(schools.select(key, *[c for c in by if c != key]), key)
    return merge_moments(joined, list(by))


# --- two-group gap ------------------------------------------------------------


def mean_gap(
    df: DataFrame,
    group: str,
    a: str,
    b: str,
    value: str,
    segments: Sequence[str] = (),
    confidence: float = 0.95,
) -> DataFrame:
    """Difference of two group means with a Welch interval, one row per segment."""
    scored = df.filter(F.col(value).isNotNull() & F.col(group).isin(a, b))

    def of(g: str, fn) -> Column:
        return fn(F.when(F.col(group) == g, F.col(value)))

    stats = scored.groupBy(*segments).agg(
        of(a, F.count).alias("n_a"),
        of(a, F.avg).alias("mean_a"),
        of(a, F.stddev_samp).alias("sd_a"),
        of(b, F.count).alias("n_b"),
        of(b, F.avg).alias("mean_b"),
        of(b, F.stddev_samp).alias("sd_b"),
    )
    var_a, var_b = F.col("sd_a") * F.col("sd_a"), F.col("sd_b") * F.col("sd_b")
    df_welch = welch_df(var_a, F.col("n_a"), var_b, F.col("n_b"))
    margin = t_quantile_of("df", confidence) * F.sqrt(var_a / F.col("n_a") + var_b / F.col("n_b"))
    gap = F.col("difference")
    out = (
        stats.filter((F.col("n_a") > 1) & (F.col("n_b") > 1))
        .withColumn("df", df_welch)
        .withColumn("difference", F.col("mean_a") - F.col("mean_b"))
        .withColumns({"ci_low": gap - margin, "ci_high": gap + margin})
    )
    significant = ~((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    return out.select(
        *segments,
        F.lit(a).alias("group_a"),
        F.lit(b).alias("group_b"),
        "mean_a",
        "mean_b",
        "n_a",
        "n_b",
        "difference",
        "ci_low",
        "ci_high",
        significant.alias("is_significant"),
        _gap_sentence(significant, confidence).alias("interpretation"),
    )


def _gap_sentence(significant: Column, confidence: float) -> Column:
    percent = F.lit(int(confidence * 100))
    spread = (F.col("sd_a") + F.col("sd_b")) / 2
    args = ["difference", percent, "ci_low", "ci_high", spread]
    real = "A gap of %+.1f points (%d%% CI [%.1f, %.1f]) excludes zero; beside a spread of ~%.0f points it is detectable but modest."
    noise = "A gap of %+.1f points (%d%% CI [%.1f, %.1f]) includes zero; beside a spread of ~%.0f points it is noise, no real difference."
    return F.when(significant, F.format_string(real, *args)).otherwise(F.format_string(noise, *args))


# --- ranking ------------------------------------------------------------------


def group_ranking(moments: DataFrame, by: Sequence[str], min_n: int = MIN_RELIABLE_N) -> DataFrame:
    """Mean and standard error per group; small groups are flagged, not ranked.

    The mean is rounded before anything is ordered by it.
    """
    var = variance(F.col("n"), F.col("m2"))
    enough = F.col("n") >= min_n
    return moments.select(
        *by,
        "n",
        F.round("mean", 1).alias("mean"),
        F.when(enough, F.round(F.sqrt(var) / F.sqrt("n"), 1)).alias("std_error"),
        F.when(enough, F.lit("reliable")).otherwise(F.lit("flagged")).alias("status"),
    )


def reliable_groups(ranking: DataFrame, by: Sequence[str]) -> DataFrame:
    """The league table: best mean first."""
    ranked = ranking.filter(F.col("status") == "reliable").drop("status")
    return ranked.orderBy(F.desc_nulls_last("mean"), *by)


def flagged_groups(ranking: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups withheld from the league table, smallest first."""
    return ranking.filter(F.col("status") == "flagged").drop("status", "std_error").orderBy("n", *by)


# --- shrinkage ----------------------------------------------------------------


def variance_parts(moments: DataFrame) -> DataFrame:
    """One row: grand mean, pooled within variance, between variance."""
    within = F.sum(F.when(F.col("n") > 1, F.col("m2"))) / F.sum(F.when(F.col("n") > 1, F.col("n") - 1))
    one = moments.agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
        within.alias("sigma2"),
        F.var_samp("mean").alias("observed"),
        F.avg(1 / F.col("n")).alias("mean_inverse_n"),
    )
    between = F.col("observed") - F.col("sigma2") * F.col("mean_inverse_n")
    return one.select(
        "grand_mean", "sigma2", F.greatest(between, F.lit(MIN_BETWEEN_VARIANCE)).alias("tau2")
    )


def shrink_means(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pull each group's mean toward the grand mean by how little it is known.

    The group table is written once and read twice; the three scalars reach it
    as a one-row subquery.
    """
    groups = stage(moments, "moments")
    parts = variance_parts(groups).select(F.struct("*")).scalar()
    weight = parts["tau2"] / (parts["tau2"] + parts["sigma2"] / F.col("n"))
    shrunk = weight * F.col("mean") + (1 - weight) * parts["grand_mean"]
    return groups.select(
        *by,
        "n",
        F.round("mean", 1).alias("raw_mean"),
        F.round(shrunk, 1).alias("shrunk_estimate"),
        F.round(weight, 3).alias("reliability"),
        F.round(F.col("mean") - shrunk, 1).alias("pulled_by"),
    ).orderBy(F.desc("shrunk_estimate"), *by)
