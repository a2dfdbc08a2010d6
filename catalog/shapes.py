"""Reshape, reconciliation and the refused override."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import MARKS
from catalog.registry import query
from tally import fixed
from tally.functions.values import canonicalise_code
from tally.operators import reshape, showcase
from tally.plans import vendor
from tally.session import stage
from tally.sources.files import scan_many

ITEMS = [m[0] for m in MARKS]
DOMAINS = ("Numeracy", "Reading", "Spelling", "Grammar and Punctuation")
UNPIVOT_SQL = "UNPIVOT (SELECT DISTINCT * FROM D_items_dup) ON " + ", ".join(ITEMS) + " INTO NAME item VALUE mark"
DOMAIN_SQL = """CASE WHEN item LIKE 'N%' THEN 'Numeracy' WHEN item LIKE 'R%' THEN 'Reading'
  WHEN CAST(regexp_extract(item, 'Q([0-9]+)', 1) AS INTEGER) BETWEEN 1 AND 6 THEN 'Spelling'
  WHEN CAST(regexp_extract(item, 'Q([0-9]+)', 1) AS INTEGER) BETWEEN 26 AND 31 THEN 'Grammar and Punctuation' END"""
LONG_SQL = f"""SELECT platform_id, {DOMAIN_SQL} AS domain, CAST(sum(CASE WHEN mark = 9 THEN 0 ELSE mark END) AS BIGINT) AS raw_score
FROM ({UNPIVOT_SQL}) GROUP BY ALL"""
CODE_SQL = "CASE lower(trim(code_raw)) " + " ".join(
    f"WHEN '{v.lower()}' THEN '{canon}'" for canon, spellings in fixed.CODES["participation"].items() for v in spellings
) + " ELSE code_raw END"
REFUSED_SQL = f"(SELECT DISTINCT student_id, domain FROM D_participation WHERE {CODE_SQL} = 'R')"


@query(
    "recode_not_attempted",
    "D_items",
    sql="SELECT platform_id, " + ", ".join(f"CASE WHEN {c} = 9 THEN 0 ELSE {c} END AS {c}" for c in ITEMS) + " FROM D_items",
)
def recode_not_attempted(items):
    return reshape.recode_items(items)


@query(
    "response_matrix",
    "D_items_dup",
    sql="""SELECT DISTINCT platform_id, CASE WHEN L3Q26 = 9 THEN 0 ELSE L3Q26 END AS L3Q26, CASE WHEN L3Q27 = 9 THEN 0 ELSE L3Q27 END AS L3Q27
FROM D_items_dup""",
)
def response_matrix(items):
    return reshape.response_matrix(items, "platform_id", "Grammar and Punctuation")


@query("unpivot_items", "D_items", sql=f"SELECT platform_id, item, mark, {DOMAIN_SQL} AS domain FROM ({UNPIVOT_SQL.replace('D_items_dup', 'D_items')})")
def unpivot_items(items):
    return reshape.unpivot_items(items, "platform_id")


@query("header_domain", "D_items", sql=f"SELECT DISTINCT item, {DOMAIN_SQL} AS domain FROM ({UNPIVOT_SQL.replace('D_items_dup', 'D_items')})")
def header_domain(items):
    headers = items.unpivot(["platform_id"], ITEMS, "item", "mark").select("item").distinct()
    return headers.withColumn("domain", reshape.domain_of(F.col("item")))


@query("reshape_paper", "D_items_dup", sql=LONG_SQL)
def reshape_paper(items):
    return reshape.reshape_paper(items, "platform_id")


@query(
    "reshape_report",
    "D_items_dup",
    sql="""WITH ids AS (SELECT count(*) AS rows_in, count(DISTINCT platform_id) AS ids FROM D_items_dup),
nines AS (SELECT count(*) AS n FROM (UNPIVOT (SELECT DISTINCT * FROM D_items_dup) ON N3Q01, N3Q02, R3Q01, R3Q02, L3Q01, L3Q26, L3Q27 INTO NAME item VALUE mark) WHERE mark = 9)
SELECT 'reshape_paper.dedup' AS rule, 'platform_id' AS "column", rows_in - ids AS changed, 'duplicate student rows' AS detail FROM ids
UNION ALL SELECT 'reshape_paper.recode_sentinel', 'vendor items', n, '9 -> 0' FROM nines
UNION ALL SELECT 'reshape_paper.melt', 'vendor', ids * 4, 'wide -> long' FROM ids""",
)
def reshape_report(items):
    return reshape.paper_report(items, "platform_id")


@query(
    "reshape_criteria",
    "D_criteria",
    sql="""SELECT platform_id, 'Writing' AS domain, coalesce(wr_audience, 0) + coalesce(wr_text_structure, 0) + coalesce(wr_ideas, 0)
  + coalesce(wr_vocabulary, 0) + coalesce(wr_cohesion, 0) + coalesce(wr_spelling, 0)
  + coalesce(wr_sentence_structure, 0) AS raw_score FROM D_criteria""",
)
def reshape_criteria(criteria):
    return reshape.reshape_writing(criteria, "platform_id")


@query(
    "criteria_report",
    "D_criteria",
    sql="""SELECT 'reshape_writing' AS rule, 'criteria' AS "column", count(DISTINCT platform_id) AS changed, 'criterion sum' AS detail FROM D_criteria""",
)
def criteria_report(criteria):
    return reshape.criteria_report(criteria, "platform_id")


@query(
    "pivot_wide",
    "D_totals",
    sql="SELECT student_id, "
    + ", ".join(f"""max(raw_score) FILTER (WHERE domain = '{d}') AS "{d}" """ for d in DOMAINS)
    + " FROM D_totals GROUP BY student_id",
)
def pivot_wide(totals):
    return reshape.pivot_wide(totals, "student_id", DOMAINS)


@query(
    "reconcile",
    "D_items_dup",
    "D_totals",
    sql=f"""WITH long AS ({LONG_SQL})
SELECT platform_id, long.domain AS domain, long.raw_score AS raw_score_vendor, t.raw_score AS raw_score_warehouse
FROM long JOIN D_totals t ON platform_id = student_id AND long.domain = t.domain WHERE abs(long.raw_score - t.raw_score) > 0""",
)
def reconcile(items, totals):
    return reshape.reconcile(reshape.reshape_paper(items, "platform_id"), totals, "platform_id")


@query(
    "reconcile_summary",
    "D_items_dup",
    "D_totals",
    sql=f"""WITH long AS ({LONG_SQL}), met AS (
SELECT long.raw_score AS v, t.raw_score AS w FROM long FULL JOIN D_totals t ON platform_id = student_id AND long.domain = t.domain)
SELECT count(*) FILTER (WHERE v IS NOT NULL AND w IS NOT NULL) AS compared, count(*) FILTER (WHERE v <> w) AS mismatched,
  count(*) FILTER (WHERE w IS NULL) AS vendor_only, count(*) FILTER (WHERE v IS NULL) AS warehouse_only FROM met""",
)
def reconcile_summary(items, totals):
    return reshape.reconcile_summary(reshape.reshape_paper(items, "platform_id"), totals, "platform_id")


def canonical(participation):
    code = canonicalise_code(F.col("code_raw"), fixed.CODES["participation"])
    return participation.select("student_id", "domain", code.alias("participation_code"))


@query(
    "refused_override",
    "D_results",
    "D_participation",
    sql=f"""SELECT r.student_id, r.domain, CASE WHEN p.student_id IS NOT NULL THEN 0.0::DOUBLE ELSE raw_score END AS raw_score,
  CASE WHEN p.student_id IS NOT NULL THEN 0.0::DOUBLE ELSE scaled_score END AS scaled_score,
  p.student_id IS NOT NULL AS refused, p.student_id IS NOT NULL AND coalesce(raw_score, 0) <> 0 AS overridden
FROM D_results r LEFT JOIN {REFUSED_SQL} p ON r.student_id = p.student_id AND r.domain = p.domain""",
)
def refused_override(results, participation):
    return reshape.zero_refused(results, canonical(participation))


@query(
    "refused_but_attempted",
    "D_results",
    "D_participation",
    sql=f"""SELECT DISTINCT student_id, domain, raw_score AS score_in_results, 'R (refused)' AS participation_code, '0' AS corrected_score
FROM D_results JOIN {REFUSED_SQL} USING (student_id, domain) WHERE raw_score IS NOT NULL""",
)
def refused_but_attempted(results, participation):
    return showcase.refused_but_attempted(results, canonical(participation), limit=None)


# Three deliveries of the totals: the first has the even keys, the second raises some of them, the third has all.
PARTS_SQL = """p AS (SELECT platform_id, domain, raw_score, 0 AS file FROM long WHERE platform_id % 2 = 0
  UNION ALL SELECT platform_id, domain, raw_score + CASE WHEN platform_id % 3 = 0 THEN 1 ELSE 0 END, 1 FROM long WHERE platform_id % 5 = 0
  UNION ALL SELECT platform_id, domain, raw_score, 2 FROM long)"""


def deliveries(items):
    scores = stage(reshape.reshape_paper(items, "platform_id").withColumnRenamed("platform_id", "PlatformId"), "scores")
    raised = F.col("raw_score") + F.when(F.col("PlatformId") % 3 == 0, 1).otherwise(0)
    return [
        scores.filter("PlatformId % 2 = 0").withColumn("file", F.lit(0)),
        scores.filter("PlatformId % 5 = 0").withColumn("raw_score", raised).withColumn("file", F.lit(1)),
        scores.withColumn("file", F.lit(2)),
    ]


@query(
    "first_file_scores",
    "D_items_dup",
    sql=f"""WITH long AS ({LONG_SQL}), {PARTS_SQL}
SELECT platform_id AS "PlatformId", domain, raw_score FROM p QUALIFY row_number() OVER (PARTITION BY platform_id, domain ORDER BY file) = 1""",
)
def first_file_scores(items):
    return vendor.first_file_wins(scan_many(deliveries(items)))


@query(
    "vendor_conflicts",
    "D_items_dup",
    sql=f"""WITH long AS ({LONG_SQL}), {PARTS_SQL}
SELECT 'vendor_scores.first_file' AS rule, 'PlatformId' AS "column", count(*) AS changed, 'different scores in several files, first file kept' AS detail
FROM (SELECT 1 FROM p GROUP BY platform_id, domain HAVING min(raw_score) <> max(raw_score))""",
)
def vendor_conflicts(items):
    return vendor.vendor_conflicts(scan_many(deliveries(items)))
