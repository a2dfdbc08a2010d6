"""Names by matching blocks, sketches, samples from groups, bands from a table, safe loads, screening by plan."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tally import session
from tally.functions import naming
from tally.operators import drift, ranking, scores
from tally.plans import plancheck, questions, vendor
from tally.session import scratch_path
from tally.sources import files


def test_matching_blocks_agree_with_the_matcher(spark):
    rng = random.Random(11)
    words = ["year", "level", "student", "id", "school", "code", "score", "wr", "aa", "abab", "é", "x1"]
    pairs = [("", ""), ("a", ""), ("", "b"), ("same", "same"), ("aaaa", "aa"), ("abcabcabc", "cabcab")]
    while len(pairs) < 1000:
        a = rng.choice("_ ").join(rng.choices(words, k=rng.randrange(1, 5)))
        b = "".join(c for c in a if rng.random() > 0.2) if rng.random() < 0.5 else "_".join(rng.choices(words, k=rng.randrange(1, 4)))
        pairs.append((a.title() if rng.random() < 0.2 else a, b))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    out = df.select("a", "b", naming.matching_share(F.col("a"), F.col("b")).alias("share"), naming.similarity(F.col("a"), F.col("b")).alias("s"))
    for r in out.collect():
        assert r["share"] == pytest.approx(SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio(), abs=1e-12), r
        assert r["s"] == pytest.approx(naming.name_similarity(r["a"], r["b"]), abs=1.1e-3), r


@pytest.mark.parametrize("shared", [0.1, 0.5, 0.9])
def test_sketched_overlap_is_within_its_error(spark, shared):
    n = 40_000
    ours = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 30).alias("few"), F.lit(1).alias("one"))
    known = spark.range(int(n * (1 - shared)), int(n * (2 - shared))).select(F.concat(F.lit("k"), F.col("id")).alias("ref"))
    out = {r["column"]: r for r in drift.sketched_overlaps(ours, known, "ref", log2_size=12).collect()}
    error = 2**-6
    assert abs(out["key"]["n_distinct"] - n) < 4 * error * n
    assert abs(out["key"]["value_overlap"] - shared) < 4 * error * (2 - shared) ** 0.5
    assert out["few"]["n_distinct"] == 30 and out["few"]["value_overlap"] == 0 and out["one"]["value_overlap"] == 0


def test_sketches_are_merged_in_one_small_shuffle(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("").alias("b"))
    plan = drift.sketched_overlaps(df, df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" in plan


@pytest.mark.parametrize("k", [1, 2, 8, 500])
def test_sample_from_groups_has_the_ranks_of_the_sample_of_rows(spark, k):
    rows = [(i, float((i * 37) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ability double")
    groups = df.groupBy("ability").agg(F.count("*").alias("n"))
    ours = ranking.spaced_groups(groups, df, "ability", "id", k).collect()
    theirs = ranking.spaced_sample(df, F.desc("ability"), F.col("id"), k=k).collect()
    assert sorted((r["rank"], r["ability"], r["position"]) for r in ours) == sorted((r["rank"], r["ability"], r["position"]) for r in theirs)
    assert len({r["id"] for r in ours}) == len(ours) == min(k, 300)


def test_bands_from_a_table(spark):
    cuts = {3: [None, 10.0, 10.5, 400.0, None], 5: [None, 0.0, None], 7: [5.0, 6.0]}
    table = [(y, a, b, f"{y}:{i}") for y, edges in cuts.items() for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    bands = spark.createDataFrame(table, "year_level int, low double, high double, band string")
    values = [-1e9, -1.0, 0.0, 5.0, 5.999, 6.0, 10.0, 10.4999, 10.5, 399.9, 400.0, 1e12, None]
    df = spark.createDataFrame([(y, v) for y in (3, 5, 7, 9, None) for v in values], "year_level int, score double")
    out = scores.with_band_table(df, bands, "score", "year_level")
    got = {(r["year_level"], r["score"]): r["band"] for r in out.collect()}
    for (y, v), band in got.items():
        inside = [n for l, a, b, n in table if l == y and v is not None and (a is None or v >= a) and (b is None or v < b)]
        assert [band] == (inside or [None]), (y, v)
    assert len(got) == 5 * len(values)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert scores.with_band_table(df, bands.limit(0), "score", "year_level").where("band IS NOT NULL").count() == 0


def tables_of(spark, level):
    one = spark.range(30).select((F.col("id") % 3).alias("year_level"), (F.col("id") % 2).alias("domain"), F.lit(level).alias("v"))
    return {"results": one, "students": one, "schools": one}


def test_a_failed_load_leaves_the_tables_as_they_were(spark):
    root = scratch_path(spark, "clean")
    by = {"results": ["year_level", "domain"]}
    files.write_tables(tables_of(spark, 1), root, by)
    held = files.read_table(spark, root, "results")
    broken = tables_of(spark, 2)
    broken["students"] = broken["students"].withColumn("v", F.raise_error(F.lit("torn")).cast("int"))
    with pytest.raises(Exception, match="torn"):
        files.write_tables(broken, root, by)
    for name in by | {"students": [], "schools": []}:
        assert {r["v"] for r in files.read_table(spark, root, name).select("v").distinct().collect()} == {1}
    files.write_tables({n: t for n, t in tables_of(spark, 3).items() if n != "schools"}, root, by)
    assert files.read_table(spark, root, "results").select(F.min("v")).first()[0] == 3
    assert files.read_table(spark, root, "schools").select(F.max("v")).first()[0] == 1
    assert held.select(F.max("v")).first()[0] == 1
    assert questions.clean_paths(root)["schools"] == files.table_path(spark, root, "schools")
    one = files.read_table(spark, root, "results").filter("year_level = 2 AND domain = 1")
    assert one.count() == 5 and "PartitionFilters: [isnotnull(year_level" in one._jdf.queryExecution().toString()
    files.replace_partitions(tables_of(spark, 4)["results"].filter("year_level = 2"), root, "results", by["results"])
    spark.catalog.refreshByPath(files.table_path(spark, root, "results"))
    assert {(r[0], r[1]) for r in files.read_table(spark, root, "results").select("year_level", "v").distinct().collect()} == {(0, 3), (1, 3), (2, 4)}


TABLES = ("ports", "calls")
ALLOWED = [
    "SELECT `using` FROM ports WHERE remark = 'reflect(1)'",
    "WITH big AS (SELECT * FROM ports), more AS (SELECT * FROM big) SELECT /*+ BROADCAST(calls) */ * FROM more JOIN calls USING (harbour)",
    "SELECT (SELECT max(depth) FROM calls) FROM `PORTS` WHERE EXISTS (SELECT 1 FROM calls)",
    "SELECT * FROM range(3), explode(array(1, 2))",
    "SELECT 1",
]
REFUSED = [
    ("SELECT `reflect`('java.lang.System', 'exit', 1)", "reflect"),
    ("SELECT /* x */ java_method /* y */ ('a', 'b') FROM ports", "java_method"),
    ("SELECT * FROM ports WHERE depth > (SELECT length(try_reflect('a', 'b')) FROM calls)", "try_reflect"),
    ("SELECT * FROM parquet.`/etc`", "parquet./etc"),
    ("SELECT * FROM (SELECT * FROM cranes)", "cranes"),
    ("WITH ports AS (SELECT * FROM other.ports) SELECT * FROM ports", "other.ports"),
    ("SELECT * FROM IDENTIFIER('cranes')", plancheck.COMPUTED),
    ("SELECT TRANSFORM(harbour) USING\n'cat' AS (x) FROM ports", plancheck.SCRIPT),
    ("SELECT * FROM read_files('/etc')", "read_files"),
    ("WITH a AS (SELECT 1) INSERT INTO ports SELECT * FROM a", plancheck.NOT_SELECT),
    ("SET x = 1", plancheck.NOT_SELECT),
]


def test_statements_are_refused_by_what_they_would_do(spark):
    for sql in ALLOWED:
        assert plancheck.refused_by_plan(spark, sql, TABLES) == "", sql
    for sql, reason in REFUSED:
        assert reason in plancheck.refused_by_plan(spark, sql, TABLES), sql


def test_first_file_wins(spark):
    rows = [("a", "Reading", 5, 0), ("a", "Reading", 9, 1), ("b", "Reading", None, 0), ("b", "Reading", 3, 1), ("c", "Writing", 1, 2)]
    parts = spark.createDataFrame(rows, "PlatformId string, domain string, raw_score int, file int")
    got = sorted(tuple(r) for r in vendor.first_file_wins(parts).collect())
    assert got == [("a", "Reading", 5), ("b", "Reading", None), ("c", "Writing", 1)]
    assert vendor.vendor_conflicts(parts).first()["changed"] == 1 and vendor.vendor_conflicts(parts.limit(0)).first()["changed"] == 0


@pytest.mark.parametrize("many", [1, 10**9])
def test_median_in_ranges_and_in_one_task(spark, monkeypatch, many):
    monkeypatch.setattr(ranking, "IN_ONE_TASK", 0 if many == 1 else many)
    for values in ([3.0, 1.0], [1.0] * 7, [float(i % 9) for i in range(100)], [5.0], [1.0, 2.0, 2.0, 7.0]):
        assert ranking.median_of(spark.createDataFrame([(v,) for v in values], "v double"), "v") == (statistics.median(values), len(values))


def test_a_staged_write_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    df.collect()
    first, second = session.stage(df), session.stage(df)
    # A frame that ran before it is staged, and one staged twice, give the same rows again.
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(df.collect())
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == before
    with pytest.raises(Exception):
        session.stage(df.select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == before
