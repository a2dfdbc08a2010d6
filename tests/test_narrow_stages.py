"""Stages whose tasks stay small: dealt by size, settings back as they were, used where whole tables are sorted."""

import pytest
from pyspark.sql import functions as F

from catalog import inference
from tally import session
from tally.operators import irt, reshape
from tally.plans import vendor

N = 60_000


@pytest.fixture
def small(spark, monkeypatch):
    """Tasks of 8 KB; by itself Spark merges anything below 1 MB."""
    monkeypatch.setattr(session, "NARROW_BYTES", "8k")
    monkeypatch.setattr(session, "NARROW_PARTITIONS", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


@pytest.fixture
def written(small, monkeypatch):
    """How many files each narrow stage of a label wrote, with small tasks."""
    files = {}

    def spy(df, label="stage", narrow=False):
        out = session.stage(df, label, narrow)
        if narrow:
            files[label] = len(out.inputFiles())
        return out

    for module in (reshape, vendor, irt, inference):
        monkeypatch.setattr(module, "stage", spy)
    return files


def test_narrow_stage_deals_small_tasks_and_leaves_the_settings(small):
    spark = small
    before = dict(spark.conf.getAll)
    grouped = spark.range(N).groupBy((F.col("id") * 7).alias("k")).count()
    wide, narrow = session.stage(grouped), session.stage(grouped, narrow=True)
    assert len(narrow.inputFiles()) > 8 >= len(wide.inputFiles())
    assert narrow.count() == N and dict(spark.conf.getAll) == before


def test_reconciliation_sorts_in_narrow_stages(spark, written):
    ids = spark.range(N).withColumn("key", F.sha2(F.col("id").cast("string"), 256))
    marks = ids.select(F.col("key").alias("PlatformId"), (F.col("id") % 2).alias("N3Q01"), F.lit(9).cast("long").alias("R3Q01"))
    totals = ids.filter("id < 50000").select(
        F.col("key").alias("student_id"), F.lit("Numeracy").alias("domain"), (F.col("id") % 2 + (F.col("id") % 100 == 0).cast("long")).alias("raw_score")
    )
    long = reshape.reshape_paper(marks.unionAll(marks))
    assert tuple(reshape.reconcile_summary(long, totals).first()) == (50_000, 500, N + 10_000, 0)
    assert min(written["vendor_totals"], written["warehouse_totals"]) > 8 and written["reconciled"] == 1
    assert reshape.reconcile(long, totals).count() == 500


def test_grid_is_fitted_from_narrow_stages(spark, written):
    marks = [((F.hash("id", F.lit(i)) % 7) > i - 4).cast("long").alias(c) for i, c in enumerate(inference.ANSWER_ITEMS)]
    segment = F.element_at(F.array(*[F.lit(s) for s in "FOP"]), (F.col("id") % 3 + 1).cast("int"))
    answers = spark.range(N).groupBy("id").count().select(F.col("id").alias("platform_id"), segment.alias("segment"), *marks)
    out = inference.irt_grid(answers).collect()
    assert len(out) == 24 and {r["year_level"] for r in out} == {3, 5, 7}
    assert "feed" in written and written["answers"] > 8
