"""Row rules: duplicates, unmatched ids, orphans and preferred sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.text import is_lossy, normalise_id
from tally.operators.audit import count_row


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row of each group of identical rows; copies collapse before the shuffle."""
    return df.dropDuplicates()


COPIES = "__copies"


def with_copies(df: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Distinct rows and how often each was delivered.

    ``flags`` name boolean columns that do not make a row different; their true
    values are counted per distinct row.
    """
    keys = [c for c in df.columns if c not in flags]
    return df.groupBy(*keys).agg(F.count("*").alias(COPIES), *[F.count_if(f).alias(f) for f in flags])


def copies_report(counted: DataFrame, name: str) -> DataFrame:
    """Report row with the number of copies removed, from ``with_copies``."""
    return count_row(counted, "drop_exact_duplicates", name, F.sum(F.col(COPIES) - 1))


def duplicate_report(df: DataFrame, name: str) -> DataFrame:
    """The same straight from the rows."""
    return copies_report(with_copies(df), name)


def _keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # rank == 1 is pushed below the shuffle as a group limit, so a hot key sends
    # one row per map task and never a whole group to one reducer.
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__pick", F.row_number().over(window)).filter("__pick = 1").drop("__pick")


def resolve_conflicts(df: DataFrame, key: str, prefer: str, ascending: bool = False) -> DataFrame:
    """One row per key: the largest (or smallest) ``prefer``, nulls last.

    Ties are settled by the remaining columns in order, so the result does not
    depend on the order in which rows arrive.
    """
    lead = F.col(prefer)
    lead = lead.asc_nulls_last() if ascending else lead.desc_nulls_last()
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in (key, prefer)]
    return _keep_one(df, [key], [lead, *rest])


def conflict_report(df: DataFrame, key: str, prefer: str, ascending: bool = False) -> DataFrame:
    """Report row with the number of rows ``resolve_conflicts`` collapses."""
    per_key = df.groupBy(key).agg((F.count("*") - 1).alias("extra"))
    keep = "min" if ascending else "max"
    return count_row(per_key, "resolve_conflicting_duplicates", key, F.sum("extra"), f"keep {keep} {prefer}")


def first_per_key(df: DataFrame, *key: str) -> DataFrame:
    """One row per key, the first in the order of the remaining columns."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in key]
    return _keep_one(df, list(key), rest or [F.lit(0)])


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def flag_unmatched(
    df: DataFrame, key: str, reference: DataFrame, reference_key: str, flag: str = "id_unmatched"
) -> DataFrame:
    """Mark rows whose key is not in the reference; nothing is repaired or dropped.

    A null key is unmatched unless the reference holds a null too.
    """
    known = reference.select(F.col(reference_key).alias("__known")).distinct().withColumn("__hit", F.lit(True))
    # Null-safe keys are hashed anew, so each side of the join is a plain shuffle.
    # A join on the partitioning of the distinct keys would save that shuffle but
    # adaptive execution cannot split a hot key there.
    joined = df.join(known, df[key].eqNullSafe(known["__known"]), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("__hit").isNull().alias(flag))


def exclude_ids(df: DataFrame, column: str, ids: Iterable) -> DataFrame:
    """Drop rows whose id is listed; rows without an id stay."""
    return df.filter(~F.coalesce(F.col(column).isin(*ids), F.lit(False)))


def exclude_members(df: DataFrame, column: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """The same against a table of ids of any size."""
    listed = reference.select(F.col(reference_key).alias("__listed"))
    return df.join(listed, df[column] == listed["__listed"], "left_anti")


def orphan_accounting(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_name: str = "left", right_name: str = "right"
) -> DataFrame:
    """Keys and rows on each side that have no partner on the other.

    Both sides are counted per key in one grouping instead of an outer join: rows
    of a hot key collapse before the shuffle, and null keys meet like any other.
    """
    tagged = left.select(*on, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionAll(
        right.select(*on, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    per_key = tagged.groupBy(*on).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"))
    one = per_key.agg(
        F.count_if(F.col("r") == 0).alias("lk"),
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("l"))), F.lit(0)).alias("lr"),
        F.count_if(F.col("l") == 0).alias("rk"),
        F.coalesce(F.sum(F.when(F.col("l") == 0, F.col("r"))), F.lit(0)).alias("rr"),
    )

    def line(side: str, other: str, keys: str, rows: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.lit(other).alias("missing_from"),
            F.col(keys).alias("n_keys"),
            F.col(rows).alias("n_rows"),
        )

    lines = F.array(line(left_name, right_name, "lk", "lr"), line(right_name, left_name, "rk", "rr"))
    return one.select(F.inline(lines))


def prefer_source(
    df: DataFrame, key: str, column: str, other: DataFrame, other_key: str, other_column: str
) -> DataFrame:
    """Take the other feed's value where ours is missing or lossy.

    Keys meet in their normalised form. Only rows that need a value are joined, so
    the rest of the table is not shuffled; the other feed is cut to the keys that are
    wanted and reduced to one value per key, so the join cannot fan out.
    """
    ours, flag = F.col(column), f"{column}_replaced"
    needed = ours.isNull() | is_lossy(ours)
    wanted = df.filter(needed).select(normalise_id(F.col(key).cast("string")).alias("__key")).distinct()
    theirs = (
        other.select(normalise_id(F.col(other_key).cast("string")).alias("__key"), F.col(other_column).alias("__value"))
        .filter(F.col("__key").isNotNull())
        .join(wanted, "__key", "left_semi")
        .groupBy("__key")
        .agg(F.min("__value").alias("__value"))
    )
    kept = df.filter(~needed).withColumn(flag, F.lit(False))
    wanting = df.filter(needed).withColumn("__ours", normalise_id(F.col(key).cast("string")))
    # Null-safe for the reason given in flag_unmatched; their keys are never null.
    filled = wanting.join(theirs, wanting["__ours"].eqNullSafe(theirs["__key"]), "left").withColumns(
        {column: F.coalesce("__value", ours), flag: F.col("__value").isNotNull()}
    )
    return kept.unionByName(filled.select(*kept.columns))
