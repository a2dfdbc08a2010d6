"""Dirty in, clean out, per rule."""

import pytest
from pyspark.sql import functions as F

from tally import fixed
from tally.functions import naming, scale, text, values
from tally.operators import audit
from tally.plans import cleaning


def through(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (text.repair_mojibake, ["KÃ¼hn", "AimÃ©e", "Dâ€™Arcy", "Chlo?", "Zo�", None],
     ["Kühn", "Aimée", "D'Arcy", "Chlo?", "Zo�", None]),
    (text.blank_placeholders, [" N/A ", "NULL", "Unknown", "\t-\t", "", "Ava ", None],
     [None, None, None, None, None, "Ava ", None]),
    (text.strip_junk, ["Mi^ra", "Tomas>", "D'Arcy", "Chlo?", "x[y]|\\z/", "Zoë-Ida"],
     ["Mira", "Tomas", "D'Arcy", "Chlo?", "xyz", "Zoë-Ida"]),
    (lambda c: text.trim_case(c, "upper"), ["\t p ", "\xa0q　", None], ["P", "Q", None]),
    (lambda c: text.trim_case(c, "title"), [" old miller's d'arcy-WEST", "éclair NOIR"], ["Old Miller'S D'Arcy-West", "Éclair Noir"]),
    (lambda c: text.trim_case(c, "initcap"), [" old miller's"], ["Old Miller's"]),
    (text.normalise_id, ["0042917", "0000", "", " 07 ", "Q20", None], ["42917", "0", "0", "7", "Q20", None]),
    (text.pad_code, ["614", "0614", "70252", "", None], ["0614", "0614", "70252", "0000", None]),
    (values.recode_sentinels, ["31", "999", "-1", "999.0", " 9999 ", "62.25", "999.00", None],
     ["31", None, None, None, None, "62.25", "999.00", None]),
    (values.coerce_numeric, ["5", " 5.5 ", "absent", "1d", "1f", ".5", "-2e3", "NaN", "", None],
     [5.0, 5.5, None, None, None, 0.5, -2000.0, None, None, None]),
    (values.whole_number, ["2024", "2024.0", "x", None], [2024, 2024, None, None]),
    (values.parse_level, ["3", "Year 9", "none", None], [3, 9, None, None]),
    (values.parse_dates,
     ["2016-10-08", "14/03/2016", "03/04/2016", "03/14/2016", "9-Sep-04", "09-SEP-88", "1/2/2016", "31/02/2016", "not-a-date", "2016-13-01", "14/03-2016", None],
     ["2016-10-08", "2016-03-14", "2016-04-03", "2016-03-14", "2004-09-09", "1988-09-09", "2016-02-01", None, None, None, None, None]),
    (text.is_lossy, ["Chlo?", "Zo�", "Zoë", None], [True, True, False, False]),
    (text.is_odd_name, ["D'Arcy-Noë W", "Mi^ra", None], [False, True, False]),
    (naming.fingerprint, ["Q204417Z", "b-7"], ["A999999A", "A-9"]),
]


@pytest.mark.parametrize("fn,dirty,clean", CASES)
def test_rule(spark, fn, dirty, clean):
    assert through(spark, fn, dirty) == clean


def test_every_spelling_of_every_code_maps(spark):
    for vocabulary in fixed.CODES.values():
        pairs = [(f"\t{v.swapcase()} ", canon) for canon, vs in vocabulary.items() for v in vs]
        out = through(spark, lambda c: values.canonicalise_code(c, vocabulary), [p[0] for p in pairs] + ["Falconry", None])
        assert out == [p[1] for p in pairs] + ["Falconry", None]


def test_not_attempted(spark):
    assert through(spark, values.recode_not_attempted, [1, 9, 0, None], "int") == [1, 0, 0, None]


def test_bands_follow_the_level_floor(spark):
    rows = [(400.0, 3), (400.0, 9), (310.0, 3), (309.9, 3), (None, 3)]
    df = spark.createDataFrame(rows, "s double, y int")
    out = [r[0] for r in df.select(scale.band(F.col("s"), scale.level_floor(F.col("y")))).collect()]
    assert out == ["Approaching Expectations", "Needs Additional Support", "Developing", "Needs Additional Support", None]


def test_labels():
    assert naming.humanise("avg_numeracy") == "Average Numeracy"
    assert naming.humanise("scaled_score") == "Scaled Score"
    assert naming.humanise("n") == "Count"
    assert naming.humanise("student_id") == "Student ID"


def test_report_counts_changes_null_safely(spark):
    rows = [("  M", "5"), ("Male", "x"), (None, None), ("Q", "999")]
    df = spark.createDataFrame(rows, "gender_code string, s string")
    done = audit.apply_rules(df, [cleaning.code("gender_code", "gender"), cleaning.sentinels("s"), cleaning.numeric("s")])
    report = {r["rule"]: (r["changed"], r["detail"]) for r in done.report().collect()}
    assert report == {
        "canonicalise_code": (2, "gender; 1 unresolved"),
        "recode_sentinels": (1, ""),
        "coerce_numeric": (1, "non-numeric -> null"),
    }
    assert [tuple(r) for r in done.clean().collect()] == [("M", 5.0), ("M", None), (None, None), ("Q", None)]
    total = audit.with_total(done.report()).filter("rule = 'total values changed'").first()
    assert total["changed"] == 4
    lines = [r["line"] for r in audit.summary_lines(done.report()).collect()]
    assert len(lines) == 4 and lines[-1].startswith("total values changed") and lines[-1].rstrip().endswith("4")


def test_report_is_one_aggregate_without_python(spark):
    df = spark.createDataFrame([("a", "1")], "family_name string, s string")
    report = audit.apply_rules(df, [cleaning.mojibake("family_name"), cleaning.junk("family_name")]).report()
    plan = report._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and plan.count("Exchange") <= 2
