"""A small delivery through the whole cleaning, and the sources around it."""

import csv
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.operators import audit
from tally.plans import analysis, cleaning, quality, vendor
from tally.session import scratch_path, stage
from tally.sources import describe, files

STUDENTS = """STUDENT_KEY,local_id,most_recent_test_level,most_recent_school_id,family_name,given_name,middle_name,gender_code,birth_date
R1,0173501,Year 3,10002,MÃ¼ller^,RenÃ©e,Ja#mes,Female,14/03/2016
R1,0173501,Year 3,10001,MÃ¼ller^,RenÃ©e,Ja#mes,Female,14/03/2016
R2,000,5,10001,O'Brien,unknown,,1,03/14/2016
R2,000,5,10001,O'Brien,unknown,,1,03/14/2016
R3,7,9,,Ren?e,Ava,NA,,2016-10-08
"""
RESULTS = """STUDENT_KEY,test_level,school_id,test_domain,cal_year,raw_score,scale_score,proficiency_band
R1,Year 3,10001,NUM,2024,5.0,absent,Strong
R2,5,10001,Maths,2024,999.0,400.5,Strong
R2,5,10001,Maths,2024,999.0,400.5,Strong
R3,9,88000,reading,2024,7.0,500.0,Developing
R1,3,10001,Astronomy,2024,-1,9999,
"""
PARTICIPATION = """platform_student_id,domain_name,participation_code,cal_year
R3,RD, refused ,2024
R1,Numeracy,Present,2024
R1,Numeracy,Present,2024
R2,NUM,P,2024
"""
SCHOOLS = """acara_id,school_name,sector_code,postcode
10001,\t st mark's college^,GOV,899
10001,\t st mark's college^,GOV,899
10002,"Holy Family, North",n/a,2000
88000,Home,GOV,0000
"""
PAPER = "PlatformId,LocalId,Surname,FirstName,Ylevel,N3Q01,N3Q02,R3Q01,L3Q01,L3Q26\n"


@pytest.fixture(scope="module")
def delivery(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in (("students", STUDENTS), ("results", RESULTS), ("participation", PARTICIPATION), ("schools", SCHOOLS)):
        (root / f"warehouse_{name}.csv").write_text(text, encoding="utf-8")
    for year in (3, 5, 7, 9):
        rows = [f"{year}-{i},{i},X,Y,{year},{i % 2},{9 if i % 3 == 0 else 1},{i % 2},1,{(i // 2) % 2}" for i in range(40)]
        head = PAPER.replace("3Q", f"{year}Q")
        (root / f"vendor_y{year}.csv").write_text(head + "\n".join(rows + rows[:5]) + "\n")
    for scope in ("y3", "y579"):
        with open(root / f"vendor_writing_{scope}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["PlatformId", "Ylevel", "Surname", "FirstName", "marker_id", "wr_ideas", "wr_cohesion"])
            for i in range(60):
                shift = {1: 3, 2: -3}.get(i % 10, 0)
                out.writerow([f"{scope}-{i}", 3, " X ", "Y", f"MKR-{i % 10}", 3 + i // 30 + (i // 10) % 2, 3 + shift])
    return str(root)


@pytest.fixture(scope="module")
def built(spark, delivery):
    out = scratch_path(spark, "built")
    return cleaning.build_tables(spark, delivery, out)


def test_students(built):
    rows = {r["student_id"]: r.asDict() for r in built[0]["students"].collect()}
    assert rows["R1"] == dict(
        student_id="R1", enrolment_id="173501", year_level=3, school_id="10001", family_name="Müller", given_name="Renée",
        middle_name="James", gender="F", birth_date="2016-03-14",
    )
    assert rows["R2"]["given_name"] is None and rows["R2"]["gender"] == "M" and rows["R2"]["enrolment_id"] == "0"
    assert rows["R3"]["family_name"] == "Ren?e" and rows["R3"]["middle_name"] is None and len(rows) == 3


def test_results(built):
    rows = {(r["student_id"], r["domain"]): r for r in built[0]["results"].collect()}
    assert len(rows) == 4
    assert rows["R1", "Numeracy"]["scaled_score"] is None and rows["R1", "Numeracy"]["raw_score"] == 5.0
    assert rows["R2", "Numeracy"]["raw_score"] is None and rows["R2", "Numeracy"]["test_year"] == 2024
    assert rows["R3", "Reading"]["raw_score"] == rows["R3", "Reading"]["scaled_score"] == 0.0
    assert rows["R3", "Reading"]["proficiency"] == "Developing"
    assert rows["R1", "Astronomy"]["raw_score"] is None and rows["R1", "Astronomy"]["year_level"] == 3


def test_schools(built):
    rows = sorted(tuple(r) for r in built[0]["schools"].collect())
    assert rows == [("10001", "St Mark'S College", "GOV", "0899"), ("10002", "Holy Family, North", None, "2000")]


def test_report_names_every_change(built):
    got = {(r["rule"], r["column"]): (r["changed"], r["detail"]) for r in built[1].collect()}
    assert got["repair_mojibake", "family_name"][0] == 2
    assert got["resolve_conflicting_duplicates", "student_id"] == (1, "keep min school_id")
    assert got["drop_exact_duplicates", "students"][0] == 1
    assert got["drop_exact_duplicates", "results"][0] == 1
    assert got["drop_exact_duplicates", "participation"][0] == 1
    assert got["recode_sentinels", "raw_score"][0] == 3
    assert got["coerce_numeric", "scaled_score"][0] == 1
    assert got["canonicalise_code", "domain"][1] == "domain; 1 unresolved"
    assert got["parse_dates", "birth_date"] == (5, "0 unparseable")
    assert got["zero_refused_scores", "raw_score"][0] == 1
    assert got["drop_non_schools", "school_id"][0] == 1
    total = built[1].agg(F.sum("changed")).first()[0]
    assert audit.with_total(built[1]).filter("column = ''").first()["changed"] == total > 30


def test_tables_are_replaced_not_appended(spark, delivery):
    out = scratch_path(spark, "twice")
    cleaning.build_tables(spark, delivery, out)
    again, _report = cleaning.build_tables(spark, delivery, out)
    assert again["results"].count() == 4


def test_dictionary_comes_from_the_tables(spark, built):
    d = describe.data_dictionary(built[0])
    row = d.filter("table = 'results' AND column = 'scaled_score'").first()
    assert (row["type"], row["n_rows"], row["position"]) == ("double", 4, 6) and "refusal" in row["description"]
    path = describe.write_dictionary(built[0], scratch_path(spark, "dictionary"))
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert "## `students` (3 rows)" in text and "| `gender` | string | M, F or X |" in text


def test_vendor_reshape_reconciles(spark, delivery):
    feeds = vendor.read_vendor(spark, delivery)
    scores = vendor.vendor_scores(feeds["paper"], feeds["writing"])
    assert scores.count() == 4 * 40 * 4 + 120
    truth = scores.select(F.col("PlatformId").alias("student_id"), "domain", "raw_score")
    mismatches, summary = vendor.reconcile_vendor(scores, truth)
    assert mismatches.isEmpty() and summary.first()["compared"] == scores.count()
    one = scores.filter("PlatformId = '5-1' AND domain = 'Numeracy'").first()["raw_score"]
    assert one == 2


def test_vendor_fits_run_together(spark, delivery):
    feeds = vendor.read_vendor(spark, delivery)
    fits = vendor.fit_paper(feeds["paper"])
    assert fits["statistics"].count() == 16
    assert {r["item"] for r in fits["items"].filter("year_level = 7").collect()} == {"N7Q01", "N7Q02", "R7Q01", "L7Q01", "L7Q26"}
    assert fits["abilities"].count() == 16 * 40
    assert fits["items"].filter("discrimination <= 0").isEmpty()


def test_marker_plan_finds_the_planted_markers(spark, delivery):
    feeds = vendor.read_vendor(spark, delivery)
    people = [(f"{s}-{i}", d, 400.0 + 10 * (i // 30)) for s in ("y3", "y579") for i in range(60) for d in ("Reading", "Writing")]
    results = spark.createDataFrame(people, "student_id string, domain string, scaled_score double")
    out = {r["marker"]: r["flag"] for r in vendor.review_markers(feeds["writing"], results).collect()}
    assert out["MKR-1"] == "lenient" and out["MKR-2"] == "harsh"


def test_quality_shows_the_delivery(spark, delivery):
    feeds = cleaning.read_feeds(spark, delivery)
    shown = [tuple(r) for r in quality.before_after_examples(feeds).select("rule", "before", "after").collect()]
    assert ("repair_mojibake", "MÃ¼ller^", "Müller^") in shown and ("blank_placeholders", "unknown", "(null)") in shown
    assert ("parse_dates", "03/14/2016", "2016-03-14") in shown and ("normalise_id", "0173501", "173501") in shown
    assert ("recode_sentinels", "999.0", "(null)") in shown and ("canonicalise_code", "Maths", "Numeracy") in shown
    assert not [r for r in shown if r[1] == "2016-10-08"]
    assert [tuple(r)[:3] for r in quality.refused_but_attempted(feeds).collect()] == [("R3", "Reading", "7.0")]
    impact = quality.sentinel_impact(feeds).first()
    assert (impact["n_sentinel"], impact["n_total"], impact["correct_mean"]) == (3, 5, 6.0)


def test_drift_check_finds_the_renamed_key(spark):
    keys = spark.range(300).select(F.format_string("R%09dK", "id").alias("k"))
    feeds = {
        "participation": keys.select(F.col("k").alias("platform_student_id"), F.lit("Reading").alias("domain_name")),
        "results": keys.select(F.col("k").alias("STUDENT_KEY")),
    }
    best = quality.drift_check(feeds).first()
    assert best["column"] == "student_platform_ref" and best["suggested"] and not best["present"]


def test_analysis_plans_on_clean_tables(spark):
    rows = [(str(i), y, f"s{i % 4}", d, 400.0 + (i * 7 % 50) + (30 if i % 2 else 0)) for i in range(400) for y in (5, 9) for d in ("Reading", "Numeracy")]
    results = spark.createDataFrame(rows, "student_id string, year_level bigint, school_id string, domain string, scaled_score double")
    students = spark.createDataFrame([(str(i), "F" if i % 2 else "M") for i in range(399)] + [("399", None)], "student_id string, gender string")
    schools = spark.createDataFrame([("s0", "A"), ("s1", "B"), ("s2", "B"), ("s3", "C")], "school_id string, school_name string")
    grid = analysis.gender_gap(results, students, None, None).collect()
    assert len(grid) == 4 and all(r["is_significant"] and r["n_a"] == 199 and r["n_b"] == 200 for r in grid)
    one = analysis.gender_gap(results, students).collect()
    assert [(r["year_level"], r["domain"]) for r in one] == [(9, "Numeracy")]
    reliable, flagged = analysis.school_ranking(results, schools, min_n=300)
    assert [r["school_name"] for r in reliable.collect()] == ["B"]
    assert {r["school_name"] for r in flagged.collect()} == {"A", "C"}
    assert {r["school_name"]: r["n"] for r in analysis.school_effects(results, schools).collect()} == {"A": 200, "B": 400, "C": 200}


# --- sources ----------------------------------------------------------------------


def test_csv_round_trip_keeps_blanks_quotes_and_tabs(spark):
    rows = [(" a ", 'say "hi", ok'), ("\tb", "x\\y"), ("NA", ""), ("null", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    path = files.write_csv(df, scratch_path(spark, "csv"))
    out = {tuple(r) for r in files.scan_text_csv(spark, path, ["a", "b"]).collect()}
    assert out == {(" a ", 'say "hi", ok'), ("\tb", "x\\y"), (None, None)}


def test_declared_header_must_match(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    path = files.write_csv(df, scratch_path(spark, "csv"))
    with pytest.raises(Exception):
        files.scan_text_csv(spark, path, ["b", "a"]).collect()


def test_answer_schema_types_marks(spark):
    types = {f.name: f.dataType for f in files.answer_schema(["PlatformId", "LocalId", "Ylevel", "N3Q01", "wr_ideas", "marker_id"]).fields}
    assert types["N3Q01"] == types["wr_ideas"] == types["Ylevel"] == types["LocalId"] == T.LongType()
    assert types["PlatformId"] == types["marker_id"] == T.StringType()


def test_inventory_counts_real_bytes(spark, delivery):
    frames = {n: files.scan_text_csv(spark, os.path.join(delivery, f"warehouse_{n}.csv")) for n in ("students", "schools")}
    raw = {n: spark.read.option("header", True).csv(os.path.join(delivery, f"warehouse_{n}.csv")) for n in frames}
    out = {r["source"]: r for r in describe.source_inventory(raw).collect()}
    size = {n: os.path.getsize(os.path.join(delivery, f"warehouse_{n}.csv")) for n in frames}
    assert out["students"]["n_rows"] == 5 and out["students"]["n_columns"] == 9 and out["students"]["n_bytes"] == size["students"]
    assert out["total"]["n_bytes"] == sum(size.values()) and out["total"]["n_files"] == 2


def test_partitioned_sink_prunes(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("year_level"), F.col("id").alias("v"))
    root = files.write_tables({"results": df}, scratch_path(spark, "t"), {"results": ["year_level"]})
    one = files.read_table(spark, root, "results").filter("year_level = 2")
    assert one.count() == 25
    assert "PartitionFilters: [isnotnull(year_level" in one._jdf.queryExecution().toString()


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(5).toDF("v"))
    assert df.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4]
