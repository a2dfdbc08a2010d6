"""Order over a whole table without passing it through one task.

A window without partition keys sends every row to a single task. Here rows are
range-partitioned on the full sort key, sorted inside their range, numbered as they
stand and written once; a handful of range counts supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.session import stage

# The median is looked for between two percentiles this far to either side of it. Their
# rank error is a tenth of that; should the counts show the middle outside, the bracket is widened.
BRACKET = 1e-5
ACCURACY = 1_000_000
# From about so many values in the bracket on they are ordered in ranges, not in one task.
IN_ONE_TASK = 1_000_000


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in the given order, with ``__part``, the number of its range, and ``__local``, its place in it from 1.

    The number of ranges is left to adaptive execution. Row ids count up inside a
    partition and carry its number in their upper bits.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    return ranged.withColumns(
        {"__part": F.shiftright("__at", 33), "__local": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1}
    ).drop("__at")


def _with_offset(ranged: DataFrame, size: Column) -> DataFrame:
    """Add ``__before``, the size of all earlier ranges, and ``__total``."""
    # One row per range, so never more rows than shuffle partitions.
    sizes = ranged.groupBy("__part").agg(size.alias("__size"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"),
        F.sum("__size").over(whole).alias("__total"),
    )
    return ranged.join(F.broadcast(offsets), "__part")


def global_row_number(df: DataFrame, *order: Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """Number all rows 1..N in the given order; ``total`` names a column for N.

    End the order with a unique column: it makes the numbering repeatable and
    lets ranges split rows that tie on the leading columns.
    """
    numbered = _with_offset(_ranged(df, order), F.count("*"))
    rank = (F.col("__before") + F.col("__local")).cast("bigint")
    extra = [F.col("__total").alias(total)] if total else []
    return numbered.select(*df.columns, rank.alias(name), *extra)


def _middle(counts: DataFrame, first: int, second: int, many: bool) -> list[float | None]:
    """The values at two ranks of ``(value, n)``; the null value, which comes first, counts what lies below all others."""
    order = F.asc_nulls_first("value")
    if many:
        running = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ranged = _with_offset(_ranged(counts, [order]).withColumn("__upto", F.sum("n").over(running)), F.sum("n"))
        last = ranged.withColumn("last", F.col("__before") + F.col("__upto"))
    else:
        last = counts.withColumn("last", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    holds = [(F.col("last") >= rank) & (F.col("last") - F.col("n") < rank) for rank in (first, second)]
    found = last.filter(holds[0] | holds[1]).orderBy(order).select("value").collect()
    return [r["value"] for r in found]


def median_of(df: DataFrame, column: str) -> tuple[float | None, int]:
    """Exact median as a double, null where there are no values, and the number of values.

    One job learns two percentiles with a known rank error and the number of values; a second counts
    what lies below them and how often each value between them occurs, and finds the middle ranks. The
    three numbers travel as literals, and the bracket is widened if the middle proves to lie outside.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    width = BRACKET
    while True:
        near = F.percentile_approx("value", [0.5 - width, 0.5 + width], ACCURACY)
        ends = near if width < 0.5 else F.array(F.min("value"), F.max("value"))
        (low, high), n = values.agg(F.coalesce(ends, F.array(F.lit(None), F.lit(None))), F.count("*")).first()
        if not n:
            return None, 0
        inside = F.when(F.col("value") >= F.lit(low), F.col("value"))
        counts = values.filter(F.col("value") <= F.lit(high)).groupBy(inside.alias("value")).agg(F.count("*").alias("n"))
        found = _middle(counts, (n + 1) // 2, (n + 2) // 2, n * width * 4 > IN_ONE_TASK)
        # The null stands for all below; two middles may be one value, and both must be there if they differ.
        if found and found[0] is not None and (width >= 0.5 or len(found) == 2 or n % 2 or _reaches(counts, n)):
            return sum(found) / len(found), n
        width *= 100


def _reaches(counts: DataFrame, n: int) -> bool:
    """Whether the counted values reach the upper of two middles."""
    return (counts.agg(F.sum("n")).first()[0] or 0) >= (n + 2) // 2


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """:func:`median_of` as one row ``(median, n)``."""
    median, n = median_of(df, column)
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"), F.lit(n).cast("bigint").alias("n"))


def approx_median(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """Median within ``n / accuracy`` ranks, from one mergeable sketch."""
    middle = F.percentile_approx(column, 0.5, accuracy)
    return df.agg(middle.alias("median"), F.count(column).alias("n"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in the given order (per-partition heaps, no full sort)."""
    return df.orderBy(*order).limit(k)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins ``(bin, midpoint, n)``; the last bin is closed, empty bins show."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = values.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    flat = ends["lo"] == ends["hi"]
    lo = F.when(flat, ends["lo"] - 0.5).otherwise(ends["lo"])
    hi = F.when(flat, ends["hi"] + 0.5).otherwise(ends["hi"])
    number = F.least(F.lit(bins), F.floor((F.col("x") - lo) / (hi - lo) * bins) + 1)
    counts = values.groupBy(number.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    midpoint = F.round(lo + (F.col("bin") - 0.5) * (hi - lo) / bins, 2)
    return every.join(counts, "bin", "left").select(
        "bin", midpoint.alias("midpoint"), F.coalesce("n", F.lit(0)).alias("n")
    )


def spaced_sample(df: DataFrame, *order: Column, k: int = 8) -> DataFrame:
    """k rows evenly spread over the ranking, first and last included."""
    ranked = global_row_number(df, *order, name="rank", total="__n")
    last = F.col("__n") - 1
    gaps = F.greatest(F.least(F.lit(k), F.col("__n")) - 1, F.lit(1))
    place = F.col("rank") - 1
    # Position i sits at floor(i * last / gaps); find the i that could land here.
    i = F.ceil(place * gaps / F.greatest(last, F.lit(1)))
    picked = ranked.filter((F.floor(i * last / gaps) == place) & (i < k))
    label = F.concat(F.format_number("rank", 0), F.lit(" of "), F.format_number("__n", 0))
    return picked.withColumn("position", label).drop("__n")


def spaced_groups(groups: DataFrame, persons: DataFrame, value: str, id_column: str, k: int = 8) -> DataFrame:
    """The rows of :func:`spaced_sample` by falling ``value``, where values repeat and ``groups`` counts them.

    ``groups`` has ``value`` and ``n`` for some hundred values at most (answer patterns); their running
    sums say in which value each place of the ranking falls, so persons are never ranked. Persons of one
    value tie, and the places that fall in it go to those with the least ids, in order; only so many rows
    of each chosen value leave a task.
    """
    sizes = groups.groupBy(value).agg(F.sum("n").alias("n"))
    upto = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = sizes.select(value, "n", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    gaps = F.greatest(F.least(F.lit(k), F.col("total")) - 1, F.lit(1))
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("total")) - 1), lambda i: F.floor(i * (F.col("total") - 1) / gaps))
    inside = F.filter(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
    picks = running.select(value, "total", F.posexplode(inside).alias("turn", "place")).withColumn("turn", F.col("turn") + 1)
    picks = stage(picks, "places")
    least = Window.partitionBy(value).orderBy(id_column)
    chosen = persons.join(picks.select(value).distinct(), value, "left_semi").select(
        id_column, value, F.row_number().over(least).alias("turn")
    ).filter(F.col("turn") <= k)
    rank = F.col("place") + 1
    label = F.concat(F.format_number(rank, 0), F.lit(" of "), F.format_number("total", 0))
    return chosen.join(picks, [value, "turn"]).select(id_column, value, rank.alias("rank"), label.alias("position"))


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, population deviation and range in one row."""
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
