"""Value rules, row rules and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from tally import fixed
from tally.functions import text, values
from tally.operators import audit, rows, sentinels
from tally.operators.audit import Rule
from tally.plans import cleaning

SEGMENTS = {
    "AUTOMOBILE": ("AUTOMOBILE", "AUTO"),
    "BUILDING": ("BUILDING", "BUIL"),
    "FURNITURE": ("FURNITURE", "FURN"),
    "HOUSEHOLD": ("HOUSEHOLD", "HOUS"),
    "MACHINERY": ("MACHINERY", "MACH"),
}
SEGMENT_SQL = "CASE lower(trim(segment_raw)) " + " ".join(
    f"WHEN '{v.lower()}' THEN '{canon}'" for canon, spellings in SEGMENTS.items() for v in spellings
) + " END"

MOJIBAKE_SQL = "text_raw"
for _bad, _good in fixed.MOJIBAKE.items():
    MOJIBAKE_SQL = f"replace({MOJIBAKE_SQL}, '{_bad}', '{_good.replace(chr(39), chr(39) * 2)}')"

PLACEHOLDER_SQL = ", ".join(f"'{w}'" for w in fixed.PLACEHOLDERS)
SENTINEL_SQL = ", ".join(f"'{w}'" for w in fixed.SENTINELS)
JUNK_SQL = f"translate(name_raw, '{fixed.JUNK}', '')"
BLANK_SQL = f"CASE WHEN lower(trim(name_raw)) IN ({PLACEHOLDER_SQL}) THEN NULL ELSE name_raw END"
RECODED_SQL = f"CASE WHEN trim(balance_raw) IN ({SENTINEL_SQL}) THEN NULL ELSE balance_raw END"
ISO_SQL = """strftime(CASE WHEN regexp_matches(date_raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(date_raw, '%Y-%m-%d')
  ELSE coalesce(try_strptime(date_raw, '%d/%m/%Y'), try_strptime(date_raw, '%d-%m-%Y'), try_strptime(date_raw, '%m/%d/%Y'),
    try_strptime(date_raw, '%m-%d-%Y'), try_strptime(date_raw, '%d-%b-%y')) END, '%Y-%m-%d')"""


# --- text -----------------------------------------------------------------------


@query(
    "repair_mojibake",
    "D_documents",
    sql=f"""SELECT doc_id, {MOJIBAKE_SQL} AS text_fixed, ({MOJIBAKE_SQL}) IS DISTINCT FROM text_raw AS changed FROM D_documents""",
)
def repair_mojibake(docs):
    done = audit.apply_rules(docs, [Rule("repair_mojibake", "text_fixed", text.repair_mojibake, source="text_raw")])
    return done.df.select("doc_id", "text_fixed", F.col("__changed_0").alias("changed"))


@query(
    "lossy_flag",
    "D_documents",
    sql="""SELECT doc_id, coalesce(strpos(text_raw, '?') > 0 OR strpos(text_raw, chr(65533)) > 0, false) AS name_lossy FROM D_documents""",
)
def lossy_flag(docs):
    return docs.select("doc_id", text.is_lossy(F.col("text_raw")).alias("name_lossy"))


@query("blank_placeholders", "D_customer", sql=f"SELECT c_custkey, {BLANK_SQL} AS name_clean FROM D_customer")
def blank_placeholders(customers):
    return customers.select("c_custkey", text.blank_placeholders(F.col("name_raw")).alias("name_clean"))


@query("strip_junk", "D_customer", sql=f"SELECT c_custkey, {JUNK_SQL} AS name_clean FROM D_customer")
def strip_junk(customers):
    return customers.select("c_custkey", text.strip_junk(F.col("name_raw")).alias("name_clean"))


@query(
    "trim_case",
    "D_customer",
    sql="""SELECT c_custkey, trim(segment_raw) AS trimmed, upper(trim(segment_raw)) AS uppered, lower(trim(segment_raw)) AS lowered
FROM D_customer""",
)
def trim_case(customers):
    c = F.col("segment_raw")
    return customers.select(
        "c_custkey",
        text.trim_case(c).alias("trimmed"),
        text.trim_case(c, "upper").alias("uppered"),
        text.trim_case(c, "lower").alias("lowered"),
    )


@query(
    "title_case",
    "D_customer",
    sql=r"""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(trim(concat(segment_raw, ' ', name_raw)), '(\p{L}+|\P{L}+)', 1),
  lambda r: concat(upper(r[1:1]), lower(r[2:]))), '') AS titled FROM D_customer""",
)
def title_case(customers):
    both = F.concat(F.col("segment_raw"), F.lit(" "), F.col("name_raw"))
    return customers.select("c_custkey", text.trim_case(both, "title").alias("titled"))


@query(
    "name_valid_flag",
    "part",
    sql=r"""SELECT p_partkey, NOT regexp_matches(p_name, '^[\p{L}'' -]+$') AS name_odd, NOT regexp_matches(p_brand, '^[\p{L}'' -]+$') AS brand_odd
FROM part""",
)
def name_valid_flag(part):
    return part.select(
        "p_partkey", text.is_odd_name(F.col("p_name")).alias("name_odd"), text.is_odd_name(F.col("p_brand")).alias("brand_odd")
    )


# --- identifiers ------------------------------------------------------------------


@query(
    "normalise_id",
    "D_customer",
    sql="""SELECT c_custkey, CASE WHEN ltrim(trim(local_id), '0') = '' THEN '0' ELSE ltrim(trim(local_id), '0') END AS id_norm FROM D_customer""",
)
def normalise_id(customers):
    return customers.select("c_custkey", text.normalise_id(F.col("local_id")).alias("id_norm"))


@query(
    "flag_unmatched_ids",
    "D_orders",
    "customer",
    sql="""SELECT o_orderkey, cust_ref, known.k IS NULL AS id_unmatched
FROM D_orders LEFT JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) AS known ON cust_ref = known.k""",
)
def flag_unmatched_ids(orders, customer):
    keys = customer.select(F.col("c_custkey").cast("string").alias("k"))
    return rows.flag_unmatched(orders, "cust_ref", keys, "k").select("o_orderkey", "cust_ref", "id_unmatched")


@query(
    "pad_code",
    "D_customer",
    sql="""SELECT c_custkey, CASE WHEN length(code_raw) < 4 THEN lpad(code_raw, 4, '0') ELSE code_raw END AS code_padded FROM D_customer""",
)
def pad_code(customers):
    return customers.select("c_custkey", text.pad_code(F.col("code_raw")).alias("code_padded"))


# --- values -----------------------------------------------------------------------


@query("recode_sentinels", "D_customer", sql=f"SELECT c_custkey, {RECODED_SQL} AS balance FROM D_customer")
def recode_sentinels(customers):
    return customers.select("c_custkey", values.recode_sentinels(F.col("balance_raw")).alias("balance"))


@query(
    "coerce_numeric",
    "D_customer",
    sql=f"""SELECT c_custkey, TRY_CAST({RECODED_SQL} AS DOUBLE) AS balance, balance_raw IS NOT NULL AND TRY_CAST(balance_raw AS DOUBLE) IS NULL AS lost
FROM D_customer""",
)
def coerce_numeric(customers):
    raw = F.col("balance_raw")
    return customers.select(
        "c_custkey",
        values.coerce_numeric(values.recode_sentinels(raw)).alias("balance"),
        audit.lost(raw, values.coerce_numeric(raw)).alias("lost"),
    )


@query("cast_level", "D_customer", sql="SELECT c_custkey, TRY_CAST(code_raw AS BIGINT) AS code_number FROM D_customer")
def cast_level(customers):
    return customers.select("c_custkey", values.whole_number(F.col("code_raw")).alias("code_number"))


@query(
    "sentinel_impact",
    "D_customer",
    sql=f"""WITH v AS (SELECT TRY_CAST(balance_raw AS DOUBLE) AS x, coalesce(trim(balance_raw) IN ({SENTINEL_SQL}), false) AS coded FROM D_customer),
one AS (SELECT count(*) FILTER (WHERE coded) AS n_sentinel, count(x) AS n_total,
  avg(x) AS naive_mean, avg(x) FILTER (WHERE NOT coded) AS correct_mean FROM v)
SELECT n_sentinel, n_total, round(naive_mean, 4) AS naive_mean, round(correct_mean, 4) AS correct_mean, round(naive_mean - correct_mean, 4) AS bias,
  concat(format('{{:,}}', n_sentinel), ' of ', format('{{:,}}', n_total), ' scores (~', printf('%.0f', n_sentinel / n_total * 100),
    '%) were codes for ''no score''. Averaged as if they were marks they read ', printf('%.1f', naive_mean), ' instead of ',
    printf('%.1f', correct_mean), ', a bias of ', printf('%+.1f', naive_mean - correct_mean), ' points.') AS sentence
FROM one""",
)
def sentinel_impact(customers):
    one = sentinels.sentinel_impact(customers, "balance_raw")
    return one.withColumns({c: F.round(c, 4) for c in ("naive_mean", "correct_mean", "bias")})


@query(
    "canonicalise_code",
    "D_customer",
    sql=f"SELECT c_custkey, coalesce({SEGMENT_SQL}, segment_raw) AS segment, {SEGMENT_SQL} IS NULL AS unresolved FROM D_customer",
)
def canonicalise_code(customers):
    c = F.col("segment_raw")
    return customers.select(
        "c_custkey",
        values.canonicalise_code(c, SEGMENTS).alias("segment"),
        values.lookup(c, SEGMENTS).isNull().alias("unresolved"),
    )


@query(
    "parse_level",
    "D_customer",
    sql="""SELECT c_custkey, TRY_CAST(nullif(regexp_extract(level_raw, '([0-9]+)', 1), '') AS BIGINT) AS level FROM D_customer""",
)
def parse_level(customers):
    return customers.select("c_custkey", values.parse_level(F.col("level_raw")).alias("level"))


@query(
    "parse_dates",
    "D_orders",
    sql=f"""SELECT o_orderkey, {ISO_SQL} AS order_date, date_raw IS DISTINCT FROM {ISO_SQL} AS changed, {ISO_SQL} IS NOT NULL AS parsed FROM D_orders""",
)
def parse_dates(orders):
    raw = F.col("date_raw")
    iso = orders.withColumn("order_date", values.parse_dates(raw))
    return iso.select(
        "o_orderkey",
        "order_date",
        audit.differs(raw, F.col("order_date")).alias("changed"),
        F.col("order_date").isNotNull().alias("parsed"),
    )


# --- rows -------------------------------------------------------------------------


@query(
    "drop_exact_duplicates",
    "D_orders_dup",
    sql="SELECT DISTINCT o_orderkey, cust_ref, priority, status, total, date_raw FROM D_orders_dup",
)
def drop_exact_duplicates(orders):
    return rows.drop_exact_duplicates(orders)


@query(
    "resolve_conflicts",
    "D_orders_dup",
    sql="""SELECT o_orderkey, cust_ref, priority, status, total, date_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC NULLS LAST, cust_ref, status, total, date_raw) AS pick FROM D_orders_dup)
WHERE pick = 1""",
)
def resolve_conflicts(orders):
    return rows.resolve_conflicts(orders, "o_orderkey", "priority")


@query(
    "first_per_key",
    "D_orders_dup",
    sql="""SELECT o_orderkey, cust_ref, priority, status, total, date_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY cust_ref, priority, status, total, date_raw) AS pick FROM D_orders_dup)
WHERE pick = 1""",
)
def first_per_key(orders):
    return rows.first_per_key(orders, "o_orderkey")


@query("distinct_pairs", "D_orders_dup", sql="SELECT DISTINCT status, priority FROM D_orders_dup")
def distinct_pairs(orders):
    return rows.distinct_pairs(orders, "status", "priority")


CUSTOMER_RULES = (
    Rule("strip_junk_characters", "name_raw", text.strip_junk),
    Rule("blank_placeholders", "name_raw", text.blank_placeholders),
    Rule(
        "canonicalise_code", "segment_raw", lambda c: values.canonicalise_code(c, SEGMENTS), detail="segment; {} unresolved",
        detail_count=lambda before, after: before.isNotNull() & values.lookup(before, SEGMENTS).isNull(),
    ),
    Rule("recode_sentinels", "balance", values.recode_sentinels, source="balance_raw"),
    Rule("coerce_numeric", "balance", values.coerce_numeric, counter=audit.lost, detail="non-numeric -> null"),
    Rule("parse_year_level", "level", values.parse_level, source="level_raw"),
    Rule("normalise_id", "local_id", text.normalise_id),
)

REPORT_SQL = f"""WITH c AS (SELECT *, {JUNK_SQL} AS n1, {SEGMENT_SQL} AS seg, {RECODED_SQL} AS b1 FROM D_customer),
d AS (SELECT *, CASE WHEN lower(trim(n1)) IN ({PLACEHOLDER_SQL}) THEN NULL ELSE n1 END AS n2,
  CAST(TRY_CAST(nullif(regexp_extract(level_raw, '([0-9]+)', 1), '') AS BIGINT) AS VARCHAR) AS lv,
  CASE WHEN ltrim(trim(local_id), '0') = '' THEN '0' ELSE ltrim(trim(local_id), '0') END AS lid FROM c),
report AS (
SELECT 'strip_junk_characters' AS rule, 'name_raw' AS "column", count(*) FILTER (WHERE n1 IS DISTINCT FROM name_raw) AS changed, '' AS detail FROM d
UNION ALL SELECT 'blank_placeholders', 'name_raw', count(*) FILTER (WHERE n2 IS DISTINCT FROM n1), '' FROM d
UNION ALL SELECT 'canonicalise_code', 'segment_raw', count(*) FILTER (WHERE coalesce(seg, segment_raw) IS DISTINCT FROM segment_raw),
  concat('segment; ', CAST(count(*) FILTER (WHERE seg IS NULL) AS VARCHAR), ' unresolved') FROM d
UNION ALL SELECT 'recode_sentinels', 'balance', count(*) FILTER (WHERE b1 IS DISTINCT FROM balance_raw), '' FROM d
UNION ALL SELECT 'coerce_numeric', 'balance', count(*) FILTER (WHERE b1 IS NOT NULL AND TRY_CAST(b1 AS DOUBLE) IS NULL), 'non-numeric -> null' FROM d
UNION ALL SELECT 'parse_year_level', 'level', count(*) FILTER (WHERE lv IS DISTINCT FROM level_raw), '' FROM d
UNION ALL SELECT 'normalise_id', 'local_id', count(*) FILTER (WHERE lid IS DISTINCT FROM local_id), '' FROM d)"""


def customer_report(customers):
    return audit.apply_rules(customers, CUSTOMER_RULES).report()


FULL_REPORT_SQL = (
    REPORT_SQL
    + """, dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM D_orders_dup)) AS changed FROM D_orders_dup),
both_parts AS (SELECT * FROM report UNION ALL SELECT 'drop_exact_duplicates', 'orders', changed, '' FROM dup)"""
)
TOTAL_SQL = "SELECT 'total values changed', '', CAST(sum(changed) AS BIGINT), '' FROM both_parts"


def both_reports(customers, orders):
    return audit.union_reports(customer_report(customers), rows.duplicate_report(orders, "orders"))


@query("clean_report", "D_customer", "D_orders_dup", sql=f"{FULL_REPORT_SQL} SELECT * FROM both_parts UNION ALL {TOTAL_SQL}")
def clean_report(customers, orders):
    return audit.with_total(both_reports(customers, orders))


@query(
    "summary_lines",
    "D_customer",
    "D_orders_dup",
    sql=f"""{FULL_REPORT_SQL}, lines(rule, col, changed, detail) AS (SELECT * FROM both_parts UNION ALL {TOTAL_SQL})
SELECT format('{{:<44}} {{:>10}}{{}}', CASE WHEN col = '' THEN rule ELSE rule || ' (' || col || ')' END, format('{{:,}}', changed),
  CASE WHEN detail = '' THEN '' ELSE '  - ' || detail END) AS line FROM lines""",
)
def summary_lines(customers, orders):
    return audit.summary_lines(both_reports(customers, orders))


# --- the load plan, on the schools feed ---------------------------------------------

SCHOOLS_SQL = rf"""WITH junk AS (SELECT *, translate(school_name, '{fixed.JUNK}', '') AS n1 FROM D_schools_feed),
tidy AS (SELECT *, array_to_string(list_transform(regexp_extract_all(trim(n1), '(\p{{L}}+|\P{{L}}+)', 1), lambda r: concat(upper(r[1:1]), lower(r[2:]))), '') AS n2,
  CASE WHEN lower(trim(sector_code)) IN ({PLACEHOLDER_SQL}) THEN NULL ELSE sector_code END AS s1,
  CASE WHEN length(postcode) < 4 THEN lpad(postcode, 4, '0') ELSE postcode END AS p1 FROM junk),
one AS (SELECT DISTINCT acara_id AS school_id, n2 AS school_name, s1 AS sector, p1 AS postcode FROM tidy),
listed(id) AS (VALUES {", ".join(f"('{i}')" for i in fixed.NON_SCHOOL_IDS)})"""


@query(
    "load_schools",
    "D_schools_feed",
    sql=f"{SCHOOLS_SQL} SELECT * FROM one WHERE school_id NOT IN (SELECT id FROM listed)",
)
def load_schools(feed):
    return cleaning.clean_schools(feed).table


@query(
    "load_schools_report",
    "D_schools_feed",
    sql=f"""{SCHOOLS_SQL}
SELECT 'strip_junk_characters' AS rule, 'school_name' AS "column", count(*) FILTER (WHERE n1 IS DISTINCT FROM school_name) AS changed, '' AS detail FROM tidy
UNION ALL SELECT 'normalise_whitespace_case', 'school_name', count(*) FILTER (WHERE n2 IS DISTINCT FROM n1), 'title' FROM tidy
UNION ALL SELECT 'blank_placeholders', 'sector_code', count(*) FILTER (WHERE s1 IS DISTINCT FROM sector_code), '' FROM tidy
UNION ALL SELECT 'pad_postcode', 'postcode', count(*) FILTER (WHERE p1 IS DISTINCT FROM postcode), '' FROM tidy
UNION ALL SELECT 'drop_exact_duplicates', 'schools', (SELECT count(*) FROM tidy) - (SELECT count(*) FROM one), ''
UNION ALL SELECT 'drop_non_schools', 'school_id', count(*) FILTER (WHERE school_id IN (SELECT id FROM listed)), 'pseudo/home' FROM one""",
)
def load_schools_report(feed):
    return cleaning.clean_schools(feed).report


@query(
    "orphans",
    "D_results",
    "D_participation",
    sql="""WITH a AS (SELECT student_id, domain, count(*) AS n FROM D_results GROUP BY ALL),
b AS (SELECT student_id, domain, count(*) AS n FROM D_participation GROUP BY ALL)
SELECT 'results' AS side, 'participation' AS missing_from, count(*) AS n_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM a ANTI JOIN b USING (student_id, domain)
UNION ALL SELECT 'participation', 'results', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM b ANTI JOIN a USING (student_id, domain)""",
)
def orphans(results, participation):
    return rows.orphan_accounting(results, participation, ["student_id", "domain"], "results", "participation")


@query(
    "preferred_source",
    "D_documents",
    "documents",
    sql="""SELECT doc_id, CASE WHEN strpos(text_raw, '?') > 0 OR strpos(text_raw, chr(65533)) > 0 THEN text ELSE text_raw END AS text_raw,
  strpos(text_raw, '?') > 0 OR strpos(text_raw, chr(65533)) > 0 AS text_raw_replaced
FROM D_documents JOIN documents USING (doc_id)""",
)
def preferred_source(dirty, documents):
    padded = documents.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("vendor_id"), "text")
    return rows.prefer_source(dirty.select("doc_id", "text_raw"), "doc_id", "text_raw", padded, "vendor_id", "text")


@query(
    "exclude_ids",
    "D_customer",
    sql=f"SELECT c_custkey, balance_raw FROM D_customer WHERE balance_raw IS NULL OR balance_raw NOT IN ({SENTINEL_SQL})",
)
def exclude_ids(customers):
    return rows.exclude_ids(customers.select("c_custkey", "balance_raw"), "balance_raw", fixed.SENTINELS)
