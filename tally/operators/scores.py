"""Raw-to-scaled lookup and the check that scores and bands conform to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.scale import band, domain_offset, level_floor, scaled_score
from tally.session import literal_rows


def score_map(dims: DataFrame) -> DataFrame:
    """Lookup rows for dims ``(year_level, domain, max_raw)``: one per raw score."""
    raws = dims.withColumn("raw_score", F.explode(F.sequence(F.lit(0), F.col("max_raw").cast("int"))))
    floor = level_floor(F.col("year_level")) + F.coalesce(domain_offset(F.col("domain")), F.lit(0.0))
    return raws.select(
        "year_level",
        "domain",
        F.col("raw_score").cast("bigint").alias("raw_score"),
        scaled_score(F.col("raw_score"), F.col("max_raw"), floor).alias("scaled_score"),
    )


def standard_dims(spark) -> DataFrame:
    """All year levels and domains of the standard test layout."""
    rows = [(y, d, n) for y in fixed.YEAR_LEVELS for d, n in fixed.DOMAIN_ITEMS.items()]
    dims = literal_rows(spark, ("year_level", "domain", "max_raw"), rows)
    return dims.withColumns({c: F.col(c).cast("bigint") for c in ("year_level", "max_raw")})


def attach_scaled(results: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of the lookup on level, domain and raw score.

    Its few key values repeat on many rows. Pass a lookup that was read or staged
    from files: Catalyst then broadcasts it by its true size and shuffles nothing.
    """
    return results.join(lookup, ["year_level", "domain", "raw_score"], "left")


def with_band(df: DataFrame, scaled: str = "scaled_score", level: str = "year_level") -> DataFrame:
    return df.withColumn("band", band(F.col(scaled), level_floor(F.col(level))))


def with_band_table(df: DataFrame, bands: DataFrame, value: str, level: str, label: str = "band") -> DataFrame:
    """The band of each row from a table ``(level, low, high, label)``: ``low <= value < high``, null for an open end.

    Values and bands are dealt to buckets about as wide as a band, so the join is an equality of level and
    bucket with the interval as residual test: it hashes or sorts, whatever the number of cuts. A row
    without value or band keeps a null; bands of a level must not overlap.
    """
    # Three numbers about the band table settle the buckets.
    first, last, n = bands.agg(F.min(F.least("low", "high")), F.max(F.greatest("low", "high")), F.count("*")).first()
    width = float(last - first) / n if n and last is not None and last > first else 1.0

    def bucket(x: Column) -> Column:
        # Beyond the cuts all values share one bucket on either side, where the open bands reach.
        at = F.floor((x.cast("double") - F.lit(float(first or 0))) / F.lit(width))
        return F.when(x.isNotNull(), F.least(F.greatest(at, F.lit(-1)), F.lit(n + 1)))

    reach = F.sequence(F.coalesce(bucket(F.col("low")), F.lit(-1)), F.coalesce(bucket(F.col("high")), F.lit(n + 1)))
    spread = bands.select(
        F.col(level).alias("__level"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col(label).alias("__label"),
        F.explode(reach).alias("__bucket"),
    )
    x = F.col(value)
    inside = (F.col("__low").isNull() | (x >= F.col("__low"))) & (F.col("__high").isNull() | (x < F.col("__high")))
    met = (F.col(level) == F.col("__level")) & (F.col("__at") == F.col("__bucket")) & inside
    joined = df.withColumn("__at", bucket(x)).join(spread, met, "left")
    return joined.select(*df.columns, F.col("__label").alias(label))


def nonconforming(results: DataFrame, lookup: DataFrame) -> DataFrame:
    """Scored rows whose pair is not in the lookup or whose band is not the derived one."""
    known = lookup.select("year_level", "domain", "raw_score", "scaled_score", F.lit(True).alias("__known"))
    met = results.filter(F.col("scaled_score").isNotNull()).join(
        known, ["year_level", "domain", "raw_score", "scaled_score"], "left"
    )
    derived = band(F.col("scaled_score"), level_floor(F.col("year_level")))
    return (
        met.withColumns(
            {
                "pair_unknown": F.col("__known").isNull(),
                "band_differs": ~F.col("proficiency").eqNullSafe(derived),
            }
        )
        .filter("pair_unknown OR band_differs")
        .drop("__known")
    )


def dense_grid(students: DataFrame, id_column: str, domains) -> DataFrame:
    """Every student with every listed domain, without a join."""
    return students.select(id_column).distinct().withColumn("domain", F.explode(F.array(*[F.lit(d) for d in domains])))
