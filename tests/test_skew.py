"""One key holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tally.operators import drift, groups, reshape, rows, showcase
from tally.plans import analysis, questions

N = 60_000


@pytest.fixture
def small_partitions(spark):
    """Make Spark see 60,000 rows the way a cluster sees a large table."""
    wanted = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, parts=8):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    return spark.range(0, N, 1, parts).select(
        key.alias("student_id"), F.lit("Reading").alias("domain"), (F.col("id") % 50).cast("double").alias("raw_score"),
        F.col("id").cast("double").alias("scaled_score"), F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows_ = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows_


def test_refused_override_splits_the_hot_key(small_partitions):
    spark = small_partitions
    part = hot(spark).select("student_id", "domain", F.lit("R").alias("participation_code"))
    plan, out = final_plan(reshape.zero_refused(hot(spark), part))
    assert "skew=true" in plan
    assert len(out) == N and all(r["raw_score"] == 0 for r in out)


def test_flagging_splits_the_hot_key(small_partitions):
    spark = small_partitions
    ref = spark.range(N).select(F.col("id").cast("string").alias("k"))
    plan, out = final_plan(rows.flag_unmatched(hot(spark), "student_id", ref, "k"))
    assert "skew=true" in plan
    assert sum(r["id_unmatched"] for r in out) == N // 3


def test_listing_refusals_splits_the_hot_key(small_partitions):
    spark = small_partitions
    part = hot(spark).select("student_id", "domain", F.lit("R").alias("participation_code"))
    plan, out = final_plan(showcase.refused_but_attempted(hot(spark).drop("note"), part, limit=None))
    assert "skew=true" in plan
    assert len(out) == N - N // 3 + 50 and {r["participation_code"] for r in out} == {"R (refused)"}


def test_preferred_source_splits_the_hot_key(small_partitions):
    spark = small_partitions
    ours = hot(spark).select("student_id", F.concat("note", F.lit("?")).alias("name"))
    theirs = hot(spark).select(F.col("student_id").alias("pid"), F.lit("clean").alias("n"))
    plan, out = final_plan(rows.prefer_source(ours, "student_id", "name", theirs, "pid", "n"))
    assert "skew=true" in plan
    assert len(out) == N and all(r["name"] == "clean" and r["name_replaced"] for r in out)


def test_reconcile_splits_the_hot_key(small_partitions):
    spark = small_partitions
    vendor = spark.range(N).select(F.col("id").cast("string").alias("PlatformId"), F.lit("Reading").alias("domain"), F.lit(0).alias("raw_score"))
    vendor = vendor.union(spark.createDataFrame([("hot", "Reading", 0)], vendor.schema))
    plan, out = final_plan(reshape.reconcile(vendor, hot(spark)))
    assert "skew=true" in plan
    assert len(out) == hot(spark).filter("raw_score > 0").count()


def test_gender_gap_splits_the_hot_key(small_partitions):
    spark = small_partitions
    results = hot(spark).withColumn("year_level", F.lit(9))
    students = spark.range(N).select(F.col("id").cast("string").alias("student_id"), F.lit("F").alias("gender"))
    students = students.union(spark.createDataFrame([("hot", "M")], students.schema))
    plan, out = final_plan(analysis.gender_gap(results, students, None, None))
    assert "skew=true" in plan
    assert [(r["n_a"], r["n_b"]) for r in out] == [(N - N // 3, N // 3)]


def test_keeping_one_row_per_hot_key_moves_few_rows(small_partitions):
    spark = small_partitions
    df = rows.resolve_conflicts(hot(spark), "student_id", "scaled_score")
    plan, out = final_plan(df)
    assert len(out) == N - N // 3 + 1
    assert {r["student_id"]: r["scaled_score"] for r in out}["hot"] == N - 3


def test_group_operators_combine_before_the_shuffle(small_partitions):
    spark = small_partitions
    dims = spark.createDataFrame([("hot", "H")], "student_id string, school_name string")
    merged = groups.school_moments(hot(spark), dims, "raw_score", key="student_id").first()
    assert merged["n"] == N // 3
    members = questions.distinct_by_group(hot(spark), dims, "student_id", "school_name", "scaled_score", "n").first()
    assert members["n"] == N // 3
    orphans = rows.orphan_accounting(hot(spark), dims.withColumn("domain", F.lit("Reading")), ["student_id", "domain"])
    assert {r["side"]: r["n_rows"] for r in orphans.collect()} == {"left": N - N // 3, "right": 0}


def test_constant_columns_do_not_hurt_drift(small_partitions):
    spark = small_partitions
    feed = hot(spark).select(F.lit("same").alias("c"), "student_id", "note")
    ref = spark.range(N).select(F.col("id").alias("ref"))
    out = {r["column"]: r["value_overlap"] for r in drift.score_columns(feed, "student_id", ref, "ref").collect()}
    assert out["c"] == 0.0 and out["student_id"] == 1.0
