"""Dirty inputs made from the driver's tables by plain SQL both engines run.

``{table}`` marks an input. Every text covers its whole table.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SQL = {}

SQL["D_customer"] = """
SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN ' - ' WHEN c_custkey % 17 = 0 THEN 'unknown'
       WHEN c_custkey % 7 = 0 THEN concat(c_name, '^')
       WHEN c_custkey % 19 = 0 THEN replace(c_name, 'Cust', 'Cust{{')
       ELSE c_name END AS name_raw,
  CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat('  ', lower(c_mktsegment)) WHEN 2 THEN substring(c_mktsegment, 1, 4)
       WHEN 3 THEN concat(c_mktsegment, ' ') ELSE 'mystery' END AS segment_raw,
  CASE WHEN c_custkey % 31 = 0 THEN '999' WHEN c_custkey % 37 = 0 THEN 'absent' WHEN c_custkey % 41 = 0 THEN '-1.0'
       WHEN c_custkey % 43 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR(20)) END AS balance_raw,
  CASE WHEN c_nationkey % 2 = 0 THEN concat('Year ', CAST(c_nationkey AS VARCHAR(5))) ELSE CAST(c_nationkey AS VARCHAR(5)) END AS level_raw,
  CASE WHEN c_custkey % 3 = 0 THEN substring(CAST(1000 + c_nationkey AS VARCHAR(5)), 2, 3) ELSE CAST(2000 + c_nationkey AS VARCHAR(5)) END AS code_raw,
  lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0') AS local_id
FROM {customer}
"""

# The schools feed as a delivery has it: dirty names, placeholder sectors, short codes, pseudo schools, some rows twice.
SQL["D_schools_feed"] = """
SELECT CASE WHEN c_custkey % 23 = 0 THEN '99999' ELSE CAST(c_custkey AS VARCHAR(20)) END AS acara_id,
  concat(segment_raw, ' ', name_raw) AS school_name, name_raw AS sector_code, code_raw AS postcode FROM {D_customer}
UNION ALL
SELECT CASE WHEN c_custkey % 23 = 0 THEN '99999' ELSE CAST(c_custkey AS VARCHAR(20)) END,
  concat(segment_raw, ' ', name_raw), name_raw, code_raw FROM {D_customer} WHERE c_custkey % 3 = 0
"""

_DAY = "lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')"
_MONTH = "lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0')"
_YEAR = "CAST(year(o_orderdate) AS VARCHAR(4))"
_NAME = (
    "CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' "
    "WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' "
    "WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' WHEN 12 THEN 'Dec' END"
)

SQL["D_orders"] = f"""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_custkey + 9000000 AS VARCHAR(20)) ELSE CAST(o_custkey AS VARCHAR(20)) END AS cust_ref,
  o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS total,
  CASE o_orderkey % 6
    WHEN 0 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR})
    WHEN 1 THEN concat({_DAY}, '-', {_MONTH}, '-', {_YEAR})
    WHEN 2 THEN concat({_MONTH}, '/', {_DAY}, '/', {_YEAR})
    WHEN 3 THEN concat({_DAY}, '-', {_NAME}, '-', substring({_YEAR}, 3, 2))
    WHEN 4 THEN 'not-a-date'
    ELSE concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}) END AS date_raw
FROM {{orders}}
"""

# Every urgent order is delivered twice, every pending one also with another priority.
SQL["D_orders_dup"] = """
SELECT o_orderkey, cust_ref, priority, status, total, date_raw FROM {D_orders}
UNION ALL SELECT o_orderkey, cust_ref, priority, status, total, date_raw FROM {D_orders} WHERE priority = '1-URGENT'
UNION ALL SELECT o_orderkey, cust_ref, '0-CLASH' AS priority, status, total, date_raw FROM {D_orders} WHERE status = 'P'
"""

# Results: one score per order; the priority plays the part of the domain.
SQL["D_results"] = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS student_id, o_orderpriority AS domain,
  CAST(CASE WHEN o_orderkey % 29 = 0 THEN 0 WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_totalprice END AS DOUBLE) AS raw_score,
  o_totalprice / 10 AS scaled_score
FROM {orders}
"""

# Low-priority pending orders have no participation row; some rows belong to no order.
SQL["D_participation"] = """
SELECT CAST(CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS VARCHAR(20)) AS student_id,
  o_orderpriority AS domain,
  CASE o_orderkey % 9 WHEN 0 THEN 'Refused' WHEN 1 THEN ' r ' WHEN 2 THEN 'Present' WHEN 3 THEN 'ABS' WHEN 4 THEN 'Not attempted' ELSE 'P' END AS code_raw
FROM {orders} WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
"""

MARKS = (("N3Q01", 1, 18), ("N3Q02", 2, 21), ("R3Q01", 3, 24), ("R3Q02", 4, 27), ("L3Q01", 5, 30), ("L3Q26", 6, 33), ("L3Q27", 7, 36))

SQL["D_items"] = (
    "SELECT l_orderkey AS platform_id,\n"
    + ",\n".join(
        f"  CAST(coalesce(max(CASE WHEN l_linenumber = {line} THEN CASE WHEN l_quantity > {cut} THEN 1 ELSE 0 END END), 9) AS BIGINT) AS {name}"
        for name, line, cut in MARKS
    )
    + "\nFROM {lineitem} GROUP BY l_orderkey\n"
)

SQL["D_items_dup"] = "SELECT * FROM {D_items} UNION ALL SELECT * FROM {D_items}"

# The warehouse's own totals, from the long lines, wrong on purpose for some orders.
SQL["D_totals"] = """
SELECT l_orderkey AS student_id, domain,
  CAST(sum(mark) + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS raw_score
FROM (
  SELECT l_orderkey,
    CASE WHEN l_linenumber <= 2 THEN 'Numeracy' WHEN l_linenumber <= 4 THEN 'Reading'
         WHEN l_linenumber = 5 THEN 'Spelling' ELSE 'Grammar and Punctuation' END AS domain,
    l_linenumber, max(CASE WHEN l_quantity > 15 + 3 * l_linenumber THEN 1 ELSE 0 END) AS mark
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber
) AS per_line GROUP BY l_orderkey, domain
"""

SQL["D_criteria"] = (
    "SELECT l_orderkey AS platform_id,\n"
    + ",\n".join(
        f"  CAST(max(CASE WHEN l_linenumber = {line} THEN floor(l_quantity / 8) END) AS BIGINT) AS {name}"
        for line, name in enumerate(("wr_audience", "wr_text_structure", "wr_ideas", "wr_vocabulary", "wr_cohesion", "wr_spelling", "wr_sentence_structure"), 1)
    )
    + "\nFROM {lineitem} GROUP BY l_orderkey\n"
)

# Seven items that share a latent trait (the order's price), for the response model.
SQL["D_answers"] = (
    "SELECT o_orderkey AS platform_id, o_orderstatus AS segment,\n"
    + ",\n".join(
        f"  CAST(max(CASE WHEN l_linenumber = {line} AND l_quantity / 25 + o_totalprice / 180000 > {cut} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
        for name, line, cut in (
            ("N3Q01", 1, 1.0), ("N3Q02", 2, 1.3), ("N3Q03", 3, 1.6), ("N3Q04", 4, 1.9),
            ("N3Q05", 5, 2.2), ("N3Q06", 6, 2.5), ("N3Q07", 7, 2.8),
        )
    )
    + "\nFROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus\n"
)

SQL["D_scripts"] = """
SELECT l_orderkey, l_linenumber, concat('MKR-', lpad(CAST(l_suppkey % 20 AS VARCHAR(3)), 2, '0')) AS marker_id,
  o_totalprice AS ability,
  l_quantity / 10 + o_totalprice / 100000 + CASE l_suppkey % 20 WHEN 3 THEN -2 WHEN 7 THEN 2 ELSE 0 END AS writing_raw
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

SQL["D_documents"] = """
SELECT doc_id, text AS text_clean,
  CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, 'é', 'Ã©'), 'ç', 'Ã§') WHEN doc_id % 7 = 0 THEN replace(text, 'é', '?') ELSE text END AS text_raw
FROM {documents}
"""

# A log of statements: every turn of every conversation inside some SQL.
SQL["D_statements"] = """
SELECT conv_id, turn,
  CASE turn % 9
    WHEN 0 THEN concat('SELECT * FROM t WHERE note = ''', replace(text, '''', ''''''), ''';')
    WHEN 1 THEN concat('/* ', text, ' */ SELECT 1')
    WHEN 2 THEN concat('SELECT 1; DROP TABLE t -- ', text)
    WHEN 3 THEN concat('-- ', replace(text, chr(10), ' '), chr(10), 'DELETE FROM t')
    WHEN 4 THEN text
    WHEN 5 THEN '   '
    WHEN 6 THEN concat('```sql', chr(10), 'WITH x AS (SELECT ''--;drop'' AS c) SELECT * FROM x', chr(10), '```')
    WHEN 7 THEN concat('update t set note = ''', replace(text, '''', ''''''), '''')
    ELSE concat('select replace(name, ''-'', '' '') from schools -- ', replace(text, chr(10), ' ')) END AS statement
FROM {conversations}
"""

# A log of questions: what was said, followed by one of the prepared wordings or none.
SQL["D_questions"] = """
SELECT conv_id, turn,
  CASE turn % 7
    WHEN 0 THEN concat(text, ' average WRITING score by year level?')
    WHEN 1 THEN concat('Top schools by average numeracy. ', text)
    WHEN 2 THEN concat(text, ' average year 9 numeracy by gender')
    WHEN 3 THEN concat('average score per domain: ', text)
    WHEN 4 THEN concat(text, ' proficiency in reading')
    WHEN 5 THEN concat('how many students in each sector ', text)
    ELSE text END AS question
FROM {conversations}
"""

# Next year's order feed: the customer key arrives under another name.
SQL["D_renamed"] = """
SELECT cust_ref AS platform_customer_ref, priority, status, CAST(total AS VARCHAR(30)) AS total, date_raw FROM {D_orders}
"""

SQL["D_levels"] = """
SELECT l_linenumber AS year_level, l_returnflag AS domain, CAST(l_quantity AS BIGINT) AS raw_score, l_extendedprice AS price
FROM {lineitem}
"""


def inputs_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a dirty projection of one."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return run(spark, sf_dir, SQL[name])


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in inputs_of(text)})


def plain(text: str) -> str:
    """The same text as ordinary SQL over named relations."""
    return text.format(**{n: n for n in inputs_of(text)})


def with_inputs(body: str, *names: str) -> str:
    """``body`` preceded by the projections it reads, dependencies first."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in SQL and name not in ordered:
            for dep in inputs_of(SQL[name]):
                need(dep)
            ordered.append(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{n} AS ({plain(SQL[n])})" for n in ordered)
    joiner = ", " if body.lstrip().upper().startswith("WITH ") else "\n"
    if joiner == ", ":
        body = body.lstrip()[5:]
    word = "WITH"
    if body.lstrip().upper().startswith("RECURSIVE "):
        word, body = "WITH RECURSIVE", body.lstrip()[10:]
    return f"{word} {ctes}{joiner}{body}"
