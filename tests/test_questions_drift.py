"""Screening, guarded execution, routing, drift, showcase."""

import pytest
from pyspark.sql import functions as F

from tally import fixed
from tally.functions import sqltext
from tally.operators import drift, routing, showcase
from tally.operators.audit import Rule
from tally.functions import text, values
from tally.plans import questions
from tally.session import scratch_path

ACCEPTED = [
    "select harbour from ports",
    "SELECT harbour, sum(tonnes) AS total FROM calls GROUP BY harbour ORDER BY total DESC",
    "SELECT depth FROM ports WHERE depth > 12.5 ;",
    "with big as (select harbour from ports where depth > 20) select count(*) from big",
    "SELECT crane -- lifts per hour\nFROM cranes",
    "SELECT 'one; two' AS both_parts",
    "SELECT harbour FROM ports WHERE remark = 'insert coin, update never'",
    "SELECT regexp_replace(harbour, '/', '-') FROM ports",
    "SELECT 'it''s a ''quay' AS q FROM ports",
    "SELECT '/* kept */ -- kept' AS literal",
    "/* o'clock */ SELECT hour FROM tides",
    "```sql\nSELECT hour FROM tides\n```",
    "SELECT dropped_at, updates, inserted_by FROM calls",
]
REJECTED = [
    ("copy tides to 'tides.csv'", "COPY"),
    ("Pragma version", "PRAGMA"),
    ("attach 'other.db'", "ATTACH"),
    ("alter table cranes rename to lifts", "ALTER"),
    ("DROP VIEW big", "DROP"),
    ("delete from calls where tonnes is null", "DELETE"),
    ("UPDATE ports SET depth = depth + 1", "UPDATE"),
    ("insert into tides select 1", "INSERT"),
    ("SELECT hour FROM tides; SELECT depth FROM ports", sqltext.MULTIPLE),
    ("SELECT 2; /* then */ DELETE FROM calls", sqltext.MULTIPLE),
    ("SELECT 2; ;", sqltext.MULTIPLE),
    ("DESCRIBE ports", sqltext.NOT_SELECT),
    ("/* nothing else */", sqltext.NOT_SELECT),
    ("SELECT hour FROM tides WHERE/* x */UPDATE", "UPDATE"),
    ("", sqltext.EMPTY),
    ("\t \n", sqltext.EMPTY),
    (None, sqltext.EMPTY),
]


def screened(spark, statements):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "i int, s string").repartition(2)
    return [r["v"] for r in df.select("i", sqltext.screen(F.col("s")).alias("v")).orderBy("i").collect()]


def test_read_only_statements_pass(spark):
    for statement, verdict in zip(ACCEPTED, screened(spark, ACCEPTED)):
        assert verdict["ok"] and not verdict["reason"], statement
    cleaned = [v["sql"] for v in screened(spark, ACCEPTED)]
    assert cleaned[2] == "SELECT depth FROM ports WHERE depth > 12.5"
    assert cleaned[4] == "SELECT crane \nFROM cranes" and cleaned[11] == "SELECT hour FROM tides"
    assert cleaned[9] == ACCEPTED[9] and cleaned[10] == "SELECT hour FROM tides"


def test_everything_else_is_refused_with_a_reason(spark):
    for (statement, reason), verdict in zip(REJECTED, screened(spark, [s for s, _r in REJECTED])):
        assert not verdict["ok"] and reason in verdict["reason"] and verdict["sql"] == "", statement


def test_screening_survives_very_long_text(spark):
    long = "SELECT '" + "it''s; drop " * 60_000 + "' AS x -- " + "tail " * 50_000
    bad = "SELECT 1 /* " + "x" * 500_000 + " */; DELETE FROM t"
    ok, refused = screened(spark, [long, bad])
    assert ok["ok"] and refused["reason"] == sqltext.MULTIPLE


@pytest.fixture(scope="module")
def clean_tables(spark):
    root = scratch_path(spark, "clean")
    results = [
        (str(i), y, f"s{i % 3}", d, float(i % 9), 300.0 + i % 50 + 10 * y, "Strong" if i % 2 else "Developing", 2024)
        for i in range(200) for y in (3, 5, 9) for d in ("Reading", "Numeracy", "Writing")
    ]
    frames = {
        "results": spark.createDataFrame(results, "student_id string, year_level bigint, school_id string, domain string, raw_score double, scaled_score double, proficiency string, test_year bigint"),
        "students": spark.createDataFrame([(str(i), "FMX"[i % 3] if i % 7 else None) for i in range(200)], "student_id string, gender string"),
        "schools": spark.createDataFrame([("s0", "North", "GOV"), ("s1", "South", "IND"), ("s2", "East", "GOV")], "school_id string, school_name string, sector string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}")
    return questions.clean_paths(root)


def test_every_prepared_question_answers(spark, clean_tables):
    for template in questions.TEMPLATES:
        answer = questions.answer_question(spark, template.question, clean_tables)
        assert answer.ok and answer.sql == template.sql, template.question
        assert answer.rows.count() > 0


def test_prepared_sql_equals_the_frame_form(spark, clean_tables):
    t = {n: spark.read.parquet(p) for n, p in clean_tables.items()}

    def asked(i):
        return [tuple(r) for r in questions.answer_question(spark, questions.TEMPLATES[i].question, clean_tables).rows.collect()]

    numeracy = t["results"].filter("domain = 'Numeracy'")
    top = questions.top_groups(numeracy, t["schools"], "school_id", "school_name", F.col("scaled_score"), "avg_numeracy")
    assert asked(1) == [tuple(r) for r in top.collect()]
    domains = questions.average_by(t["results"], ["domain"], "scaled_score", "avg_scaled_score")
    assert sorted(asked(3)) == sorted(tuple(r) for r in domains.collect())
    bands = questions.band_counts(t["results"].filter("year_level = 5 AND domain = 'Reading'"), "proficiency")
    assert asked(4) == [tuple(r) for r in bands.collect()]
    sectors = questions.distinct_by_group(t["results"], t["schools"], "school_id", "sector", "student_id", "students")
    assert asked(5) == [tuple(r) for r in sectors.collect()]


def test_miss_offers_the_closest_questions(spark, clean_tables):
    answer = questions.answer_question(spark, "weather in each school sector", clean_tables)
    assert not answer.ok and answer.sql == "" and len(answer.examples) == 3
    assert answer.examples[0] == "how many students sat, by school sector"


def test_destructive_sql_is_shown_but_never_run(spark, clean_tables):
    answer = questions.run_guarded(spark, "DROP TABLE students; --", clean_tables)
    assert not answer.ok and answer.sql and answer.rows is None
    assert spark.read.parquet(clean_tables["students"]).count() == 200


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM csv.`/etc/hostname`",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT TRANSFORM(student_id) USING 'cat' FROM students",
        "SELECT nothing FROM students",
    ],
)
def test_files_scripts_and_jvm_code_are_out_of_reach(spark, clean_tables, sql):
    answer = questions.run_guarded(spark, sql, clean_tables)
    assert not answer.ok and answer.rows is None and answer.error and answer.sql


def test_the_word_using_in_text_is_no_script(spark, clean_tables):
    sql = "SELECT count(*) AS n FROM students JOIN results USING (student_id) WHERE gender <> 'using ''x'''"
    answer = questions.run_guarded(spark, sql, clean_tables)
    assert answer.ok and answer.rows.first()["n"] > 0


def test_guard_leaves_the_session_alone_and_caps_rows(spark, clean_tables):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    answer = questions.run_guarded(spark, "SELECT * FROM results LIMIT 999999", clean_tables, row_limit=50)
    assert answer.truncated and not questions.run_guarded(spark, "SELECT * FROM results LIMIT 50", clean_tables, row_limit=50).truncated
    assert answer.ok and answer.rows.count() == 50
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before
    assert not spark.catalog.tableExists("results")


def test_routing_needs_most_words_and_the_first_wins(spark):
    T = routing.Template
    ts = (T(("a", "b", "c"), "one", "1"), T(("a", "b", "d"), "two", "2"), T(("x", "y"), "three", "3"))
    df = spark.createDataFrame([("A b!",), ("b a d",), ("x",), ("Y-x z",), (None,)], "q string")
    out = [r["matched"] for r in routing.route(df, "q", ts).collect()]
    assert out == ["one", "two", None, "three", None]
    near = routing.nearest(df.limit(1), "q", ts, 2).orderBy("place").collect()
    assert [r["example"] for r in near] == ["one", "two"]


# --- drift ------------------------------------------------------------------------


def ids(spark, n=500):
    return spark.range(n).select(F.format_string("R%09dK", "id").alias("ref"))


def test_renamed_column_is_suggested(spark):
    feed = ids(spark).select(F.col("ref").alias("student_platform_id"), F.lit("Smith").alias("surname"), F.lit("R000000001K").alias("constant"))
    out = drift.detect_drift(feed, "student_id", "platform_student_id", ids(spark), "ref").collect()
    assert [r["column"] for r in out if r["suggested"]] == ["student_platform_id"]
    best = out[0]
    assert (best["value_overlap"], best["format_match"]) == (1.0, 1.0)
    assert {r["column"]: r["value_overlap"] for r in out}["constant"] == 0.0


def test_name_score_uses_the_sequence_ratio_by_default(spark):
    out = drift.score_columns(ids(spark).withColumnRenamed("ref", "platform_student_id"), "student_id", ids(spark), "ref").first()
    # ratio 2*10/29, words {platform, student, id} against {student, id}
    assert out["name_similarity"] == round(0.5 * 20 / 29 + 0.5 * 2 / 3, 3)
    assert abs(out["combined"] - (0.25 * out["name_similarity"] + 0.75)) < 0.00051


def test_present_column_gets_no_suggestion(spark):
    feed = ids(spark).select(F.col("ref").alias("platform_student_id"), F.lit("x").alias("other"))
    out = drift.detect_drift(feed, "student_id", "platform_student_id", ids(spark), "ref").collect()
    assert all(r["present"] and not r["suggested"] for r in out)


def test_overlap_beats_a_close_name_and_zeros_do_not_matter(spark):
    feed = spark.range(100).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("zz"), (F.col("id") + 90000).alias("student_id_x"))
    ref = spark.range(100).select(F.col("id").alias("ref"))
    out = drift.detect_drift(feed, "student_id", "gone", ref, "ref").collect()
    assert out[0]["column"] == "zz" and out[0]["value_overlap"] == 1.0


# --- showcase ---------------------------------------------------------------------

RULES = (
    Rule("strip_junk_characters", "name", text.strip_junk, detail="junk"),
    Rule("blank_placeholders", "name", text.blank_placeholders, detail="placeholder"),
    Rule("parse_dates", "d", values.parse_dates, detail="dates"),
)


def test_examples_show_nulls_and_leave_iso_dates_out(spark):
    df = spark.createDataFrame([("A^li", "2016-10-08"), ("A^li", "14/03/2016"), ("N/A", "2016-10-08"), (None, "bad")], "name string, d string")
    out = [tuple(r) for r in showcase.before_after(df, RULES).orderBy("position", "example").select("rule", "before", "after").collect()]
    assert out == [
        ("strip_junk_characters", "A^li", "Ali"), ("strip_junk_characters", "N/A", "NA"),
        ("blank_placeholders", "N/A", "(null)"),
        ("parse_dates", "14/03/2016", "2016-03-14"), ("parse_dates", "bad", "(null)"),
    ]
    assert showcase.before_after(df, RULES, 1).count() == 3


def test_refused_but_attempted(spark):
    res = spark.createDataFrame([("1", "Reading", "20.0"), ("2", "Reading", "999.0"), ("3", "Reading", None), ("4", "Reading", "5.0")], "student_id string, domain string, raw_score string")
    part = spark.createDataFrame([(str(i), "Reading", "R" if i < 4 else "P") for i in range(1, 5)], "student_id string, domain string, participation_code string")
    assert [tuple(r) for r in showcase.refused_but_attempted(res, part).collect()] == [("1", "Reading", "20.0", "R (refused)", "0")]


def report(spark):
    rows = [("recode_sentinels", "a", 3, ""), ("recode_sentinels", "b", 4, ""), ("zero_refused_scores", "raw_score", 2, ""), ("custom_rule", "c", 9000, ""), ("parse_dates", "d", 0, "")]
    return spark.createDataFrame(rows, "rule string, column string, changed bigint, detail string")


def test_totals_tiles_and_summary(spark):
    assert [tuple(r) for r in showcase.rule_totals(report(spark)).collect()] == [("custom_rule", 9000), ("recode_sentinels", 7), ("zero_refused_scores", 2)]
    assert [r[0] for r in showcase.rule_total_lines(report(spark)).collect()] == ["custom_rule: 9,000", "recode_sentinels: 7", "zero_refused_scores: 2", "total values changed: 9,009"]
    tiles = showcase.rule_tiles(report(spark)).orderBy("position").collect()
    assert [r["rule"] for r in tiles] == list(fixed.HEADLINE_RULES) and [r["changed"] for r in tiles] == [0, 7, 0, 2, 0, 0]
    summary = showcase.report_summary(report(spark)).first()["summary"]
    for piece in ("9,009", "9,000", "applied the rule custom rule", "7 'no score'", "2 refused"):
        assert piece in summary
