"""Marker severity: which markers score far from their peers, given ability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.ranking import median_of, global_row_number
from tally.session import stage

# Normal-consistency factor of the MAD and the flag threshold.
MAD_FACTOR = 1.4826
SEVERITY_LIMIT = 3.5
MIN_MAD = 1e-9


def other_ability(results: DataFrame, key: str = "student_id", skip: str = "Writing") -> DataFrame:
    """Mean scaled score per student over all other domains."""
    scored = results.filter((F.col("domain") != skip) & F.col("scaled_score").isNotNull())
    return scored.groupBy(key).agg(F.avg("scaled_score").alias("other_ability"))


def marker_review(scripts: DataFrame, marker: str, score: str, ability: str) -> DataFrame:
    """Review queue of markers by severity, most anomalous first.

    Residuals come from a straight-line fit of score on ability. Fit and residual
    moments per marker both follow from the markers' joint moments, so the scripts
    are read once and everything after is one row per marker.
    """
    x, y = F.col(ability), F.col(score)
    paired = scripts.filter(x.isNotNull() & y.isNotNull())
    n = F.count("*")
    per_marker = stage(
        paired.groupBy(F.col(marker).alias("marker")).agg(
            n.alias("n_scripts"),
            F.avg(x).alias("mx"),
            F.avg(y).alias("my"),
            (F.var_pop(x) * n).alias("sxx"),
            (F.var_pop(y) * n).alias("syy"),
            (F.covar_pop(x, y) * n).alias("sxy"),
        ),
        "markers",
    )
    weight = F.col("n_scripts")
    centre = per_marker.select(
        F.struct(
            (F.sum(weight * F.col("mx")) / F.sum(weight)).alias("x"),
            (F.sum(weight * F.col("my")) / F.sum(weight)).alias("y"),
        )
    ).scalar()
    dx, dy = F.col("mx") - centre["x"], F.col("my") - centre["y"]
    slope = per_marker.select(
        F.sum(F.col("sxy") + weight * dx * dy) / F.sum(F.col("sxx") + weight * dx * dx)
    ).scalar()
    resid_ss = F.greatest(
        F.col("syy") - 2 * slope * F.col("sxy") + slope * slope * F.col("sxx"), F.lit(0.0)
    )
    spread = F.when(weight > 1, F.sqrt(resid_ss / (weight - 1)))
    summary = stage(
        per_marker.select(
            "marker",
            "n_scripts",
            F.round(dy - slope * dx, 2).alias("mean_residual"),
            F.round(spread / F.sqrt(weight), 3).alias("std_error"),
        ),
        "residuals",
    )
    # Two numbers about one row per marker; they return as literals.
    median = F.lit(median_of(summary, "mean_residual")[0]).cast("double")
    distances = summary.select(F.abs(F.col("mean_residual") - median).alias("distance"))
    mad = F.lit(median_of(distances, "distance")[0]).cast("double")
    mad = F.when(mad == 0, F.lit(MIN_MAD)).otherwise(mad)
    severity = F.round((F.col("mean_residual") - median) / (MAD_FACTOR * mad), 1)
    side = F.when(F.col("mean_residual") < median, F.lit("harsh")).otherwise(F.lit("lenient"))
    flagged = summary.withColumn("severity_score", severity).withColumn(
        "flag", F.when(F.abs("severity_score") > SEVERITY_LIMIT, side).otherwise(F.lit("ok"))
    )
    ranked = global_row_number(flagged, F.abs("severity_score").desc(), F.col("marker"), name="review_rank")
    return ranked.select(
        "review_rank", "marker", "n_scripts", "mean_residual", "std_error", "severity_score", "flag"
    )
