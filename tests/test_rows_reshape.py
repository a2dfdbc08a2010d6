"""Row rules, reshape, the refused override, reconciliation."""

from pyspark.sql import functions as F

from tally.functions.naming import jaccard
from tally.operators import reshape, rows, scores


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_conflicts_keep_the_named_end_and_put_nulls_last(spark):
    df = spark.createDataFrame(
        [("A", 1, "x"), ("A", 2, "y"), ("A", None, "z"), (None, 5, "p"), (None, 4, "q")], "k string, u int, v string"
    )
    assert rows_of(rows.resolve_conflicts(df, "k", "u"), "k") == [(None, 5, "p"), ("A", 2, "y")]
    assert rows_of(rows.resolve_conflicts(df, "k", "u", ascending=True), "k") == [(None, 4, "q"), ("A", 1, "x")]
    assert rows.conflict_report(df, "k", "u").first()["changed"] == 3


def test_keep_rule_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("u"))
    plan = rows.resolve_conflicts(df, "k", "u")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    shuffle = plan.index("Exchange")
    assert plan.index("Final") < shuffle < plan.index("Partial")


def test_duplicates_are_counted(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", None), ("b", None)], "k string, v int")
    assert rows.drop_exact_duplicates(df).count() == 2
    assert rows.duplicate_report(df, "t").first()["changed"] == 3


def test_unmatched_ids_are_flagged_and_null_needs_a_null(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    ref = spark.createDataFrame([("1",), ("1",)], "r string")
    assert rows_of(rows.flag_unmatched(df, "k", ref, "r"), "k") == [(None, True), ("1", False), ("2", True)]
    with_null = ref.union(spark.createDataFrame([(None,)], "r string"))
    assert rows_of(rows.flag_unmatched(df, "k", with_null, "r"), "k")[0] == (None, False)


def test_exclusion_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("1",), ("88000",), (None,)], "k string")
    assert rows_of(rows.exclude_ids(df, "k", ["88000"]), "k") == [(None,), ("1",)]
    ref = spark.createDataFrame([("88000",)], "r string")
    assert rows_of(rows.exclude_members(df, "k", ref, "r"), "k") == [(None,), ("1",)]


def test_orphans_both_ways(spark):
    a = spark.createDataFrame([("1", "d"), ("1", "d"), ("2", "d"), (None, "d")], "id string, domain string")
    b = spark.createDataFrame([("2", "d"), ("3", "d"), ("3", "e"), (None, "d")], "id string, domain string")
    out = rows_of(rows.orphan_accounting(a, b, ["id", "domain"], "a", "b"), "side")
    assert out == [("a", "b", 1, 2), ("b", "a", 2, 2)]


def test_preferred_source_only_fills_lossy_or_missing(spark):
    ours = spark.createDataFrame([("007", "Jos?"), ("8", None), ("9", "Ann"), ("10", "X?")], "id string, name string")
    theirs = spark.createDataFrame([(7, "José"), (7, "José"), (8, "Bo"), (9, "Other")], "pid int, n string")
    out = {r["id"]: (r["name"], r["name_replaced"]) for r in rows.prefer_source(ours, "id", "name", theirs, "pid", "n").collect()}
    assert out == {"007": ("José", True), "8": ("Bo", True), "9": ("Ann", False), "10": ("X?", False)}


WIDE = "PlatformId string, Ylevel int, N3Q01 int, N3Q02 int, N3Q03 int, R3Q01 int, R3Q02 int, L3Q06 int, L3Q07 int, L3Q26 int, L3Q32 int"


def wide(spark):
    rows_ = [("a", 3, 1, 9, 1, 1, 0, 1, 1, 1, 1), ("a", 3, 1, 9, 1, 1, 0, 1, 1, 1, 1), ("b", 3, None, None, None, 0, 9, 9, 1, 0, 1), (None, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    return spark.createDataFrame(rows_, WIDE)


def test_header_domains(spark):
    headers = ["N3Q01", "R9Q08", "L3Q01", "L3Q06", "L3Q07", "L3Q26", "L3Q31", "L3Q32", "Surname", "NQ1"]
    want = ["Numeracy", "Reading", "Spelling", "Spelling", None, "Grammar and Punctuation", "Grammar and Punctuation", None, None, None]
    assert [reshape.header_domain(h) for h in headers] == want
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h string")
    assert [r[0] for r in df.orderBy("i").select(reshape.domain_of(F.col("h"))).collect()] == want


def test_paper_scores(spark):
    out = rows_of(reshape.reshape_paper(wide(spark)), "PlatformId", "domain")
    assert out == [
        ("a", "Grammar and Punctuation", 1), ("a", "Numeracy", 2), ("a", "Reading", 1), ("a", "Spelling", 1),
        ("b", "Grammar and Punctuation", 0), ("b", "Numeracy", 0), ("b", "Reading", 0), ("b", "Spelling", 0),
    ]


def test_paper_scores_equal_unpivot_and_group(spark):
    one_each = wide(spark).filter("PlatformId IS NOT NULL").dropDuplicates()
    long = reshape.unpivot_items(one_each, "PlatformId").withColumn("mark", F.when(F.col("mark") == 9, 0).otherwise(F.col("mark")))
    grouped = long.groupBy("PlatformId", "domain").agg(F.coalesce(F.sum("mark"), F.lit(0)).alias("raw_score"))
    assert rows_of(reshape.reshape_paper(wide(spark)), "PlatformId", "domain") == rows_of(grouped, "PlatformId", "domain")


def test_paper_scores_need_one_shuffle(spark):
    plan = reshape.reshape_paper(wide(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_writing_sums_known_criteria(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 3, None), ("b", 2, 4)], "PlatformId string, wr_ideas int, wr_cohesion int")
    assert rows_of(reshape.reshape_writing(df), "PlatformId") == [("a", "Writing", 3), ("b", "Writing", 6)]


def test_pivot_and_matrix(spark):
    long = spark.createDataFrame([("a", "Reading", 3), ("a", "Numeracy", 4), ("b", "Reading", 1)], "id string, domain string, raw_score int")
    assert rows_of(reshape.pivot_wide(long, "id", ["Reading", "Numeracy"]), "id") == [("a", 3, 4), ("b", 1, None)]
    assert rows_of(reshape.response_matrix(wide(spark).filter("PlatformId = 'a'"), "PlatformId", "Numeracy"), "PlatformId") == [("a", 1, 0, 1)]


def test_refusal_zeroes_and_counts_only_real_scores(spark):
    res = spark.createDataFrame(
        [("1", "Reading", 20.0, 450.0, "Strong"), ("2", "Reading", None, None, None), ("3", "Reading", 0.0, 9.0, None), ("4", "Reading", 5.0, 6.0, None), (None, "Reading", 7.0, 8.0, None)],
        "student_id string, domain string, raw_score double, scaled_score double, proficiency string",
    )
    part = spark.createDataFrame(
        [("1", "Reading", "R"), ("1", "Reading", "R"), ("2", "Reading", "R"), ("3", "Reading", "R"), ("4", "Numeracy", "R"), (None, "Reading", "R")],
        "student_id string, domain string, participation_code string",
    )
    out = reshape.zero_refused(res, part)
    assert rows_of(out.select("student_id", "raw_score", "scaled_score", "proficiency", "overridden"), "student_id") == [
        (None, 0.0, 0.0, None, True), ("1", 0.0, 0.0, "Strong", True), ("2", 0.0, 0.0, None, False), ("3", 0.0, 0.0, None, False), ("4", 5.0, 6.0, None, False),
    ]
    assert reshape.refused_report(out).first()["changed"] == 2


def test_reconcile_passes_and_bites(spark):
    vendor = spark.createDataFrame([("a", "Reading", 5), ("b", "Reading", 6), ("c", "Reading", 1)], "PlatformId string, domain string, raw_score int")
    good = spark.createDataFrame([("a", "Reading", 5), ("b", "Reading", 6), ("d", "Reading", 1)], "student_id string, domain string, raw_score int")
    bad = good.withColumn("raw_score", F.when(F.col("student_id") == "b", 99).otherwise(F.col("raw_score")))
    assert reshape.reconcile(vendor, good).isEmpty()
    assert rows_of(reshape.reconcile(vendor, bad), "PlatformId") == [("b", "Reading", 6, 99)]
    assert reshape.reconcile(vendor, bad, tolerance=100).isEmpty()
    twice = bad.union(bad)
    assert tuple(reshape.reconcile_summary(vendor, twice).first()) == (4, 2, 1, 2)


def test_score_map_and_conformance(spark):
    lookup = scores.score_map(scores.standard_dims(spark))
    assert lookup.count() == 4 * (9 + 9 + 7 + 7 + 11)
    ends = {(r["raw_score"]): r["scaled_score"] for r in lookup.filter("year_level = 3 AND domain = 'Numeracy'").collect()}
    assert ends[0] == 285.0 and ends[8] == 545.0 and ends[4] == 415.0
    good = scores.with_band(lookup).withColumnRenamed("band", "proficiency")
    assert scores.nonconforming(good, lookup).isEmpty()
    bad = good.withColumn("scaled_score", F.when((F.col("raw_score") == 1) & (F.col("year_level") == 3), F.col("scaled_score") + 0.1).otherwise(F.col("scaled_score")))
    assert scores.nonconforming(bad, lookup).filter("pair_unknown").count() == 5


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("x"), F.col("y"))).collect()] == [1 / 3, 0.0]
