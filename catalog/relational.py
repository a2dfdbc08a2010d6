"""Scans, projections, filters, joins, aggregates, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from tally import fixed
from tally.functions import naming, values
from tally.operators import groups, ranking, rows, scores
from tally.operators.routing import question_words
from tally.plans import questions
from tally.session import scratch_path, stage
from tally.sources import describe, files

# --- sources and sinks ------------------------------------------------------------

NA_SQL = ", ".join(f"'{t}'" for t in fixed.NA_TOKENS)


@query(
    "scan_text_csv",
    "D_customer",
    sql="SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, "
    + ", ".join(
        f"CASE WHEN {c} IN ({NA_SQL}) THEN NULL ELSE {c} END AS {c}"
        for c in ("name_raw", "segment_raw", "balance_raw", "level_raw", "code_raw", "local_id")
    )
    + " FROM D_customer",
)
def scan_text_csv(customers):
    spark = customers.sparkSession
    path = files.write_csv(customers, scratch_path(spark, "text-csv"))
    return files.scan_text_csv(spark, path, customers.columns)


@query("scan_typed_csv", "D_items", sql="SELECT CAST(platform_id AS VARCHAR) AS platform_id, * EXCLUDE (platform_id) FROM D_items")
def scan_typed_csv(items):
    spark = items.sparkSession
    path = files.write_csv(items, scratch_path(spark, "typed-csv"))
    return files.scan_typed_csv(spark, path, files.answer_schema(files.csv_header(spark, path)))


@query(
    "scan_many",
    "D_items",
    "D_criteria",
    sql="""SELECT platform_id, N3Q01, N3Q02, R3Q01, R3Q02, L3Q01, L3Q26, L3Q27, CAST(NULL AS BIGINT) AS wr_audience, CAST(NULL AS BIGINT) AS wr_text_structure,
  CAST(NULL AS BIGINT) AS wr_ideas, CAST(NULL AS BIGINT) AS wr_vocabulary, CAST(NULL AS BIGINT) AS wr_cohesion, CAST(NULL AS BIGINT) AS wr_spelling,
  CAST(NULL AS BIGINT) AS wr_sentence_structure FROM D_items
UNION ALL SELECT platform_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, wr_audience, wr_text_structure, wr_ideas, wr_vocabulary, wr_cohesion, wr_spelling, wr_sentence_structure FROM D_criteria""",
)
def scan_many(items, criteria):
    return files.scan_many([items, criteria])


@query("sink_csv", "D_orders", sql="SELECT o_orderkey, cust_ref, priority, status, total, date_raw FROM D_orders")
def sink_csv(orders):
    spark = orders.sparkSession
    path = files.write_csv(orders, scratch_path(spark, "csv"))
    return files.scan_typed_csv(spark, path, orders.schema)


@query(
    "sink_tables",
    "D_orders",
    "customer",
    sql="""SELECT status, c_mktsegment, count(*) AS n, round(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
FROM D_orders JOIN customer ON cust_ref = CAST(c_custkey AS VARCHAR) GROUP BY ALL""",
)
def sink_tables(orders, customer):
    spark = orders.sparkSession
    root = files.write_tables({"orders": orders, "customer": customer}, scratch_path(spark, "tables"), {"orders": ["status"]})
    names = {"written_orders": "orders", "written_customer": "customer"}
    files.register({view: files.read_table(spark, root, n) for view, n in names.items()})
    out = spark.sql(
        """SELECT status, c_mktsegment, count(*) AS n, round(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
        FROM written_orders JOIN written_customer ON cust_ref = CAST(c_custkey AS STRING) GROUP BY ALL"""
    )
    files.unregister(spark, names)
    return out


@query(
    "data_dictionary",
    "orders",
    "customer",
    sql="""WITH c("table", position, "column", type, description) AS (VALUES
  ('orders', 1::BIGINT, 'o_orderkey', 'bigint', 'order'), ('orders', 2, 'o_custkey', 'bigint', ''), ('orders', 3, 'o_orderstatus', 'string', ''),
  ('orders', 4, 'o_totalprice', 'double', 'price'), ('orders', 5, 'o_orderdate', 'timestamp_ntz', ''), ('orders', 6, 'o_orderpriority', 'string', ''),
  ('customer', 1, 'c_custkey', 'bigint', ''), ('customer', 2, 'c_name', 'string', ''), ('customer', 3, 'c_nationkey', 'int', ''),
  ('customer', 4, 'c_acctbal', 'double', ''), ('customer', 5, 'c_mktsegment', 'string', '')),
n("table", n_rows) AS (SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT * FROM c JOIN n USING ("table")""",
)
def data_dictionary(orders, customer):
    notes = {"o_orderkey": "order", "o_totalprice": "price"}
    return describe.data_dictionary({"orders": orders, "customer": customer}, notes)


INVENTORY = ("orders", "lineitem", "documents", "conversations")


# Rows and columns; files and their bytes are properties of the folder, which the tests look up there.
@query(
    "source_inventory",
    *INVENTORY,
    sql="WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in INVENTORY
    )
    + ") SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n_rows) AS BIGINT), NULL FROM c",
)
def source_inventory(*frames):
    return describe.source_inventory(dict(zip(INVENTORY, frames))).select("source", "n_rows", "n_columns")


@query(
    "humanised",
    "orders",
    sql="""SELECT o_orderstatus AS "Status", round(avg(o_totalprice), 4) AS "Average Total", count(*) AS "Count", min(o_orderkey) AS "Minimum ID"
FROM orders GROUP BY o_orderstatus""",
)
def humanised(orders):
    plain = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("avg_total"), F.count("*").alias("n"), F.min("o_orderkey").alias("min_id")
    )
    return naming.humanise_columns(plain)


# --- projections and filters --------------------------------------------------------


@query("alias_project", "orders", sql="SELECT o_orderkey AS result_id, o_custkey AS student_id, o_orderpriority AS domain FROM orders")
def alias_project(orders):
    names = {"o_orderkey": "result_id", "o_custkey": "student_id", "o_orderpriority": "domain"}
    return orders.select(*names).withColumnsRenamed(names)


@query(
    "filter_param",
    "lineitem",
    sql="""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem
WHERE l_linenumber = 3 AND l_linestatus = 'F' GROUP BY l_returnflag""",
)
def filter_param(lineitem):
    return lineitem.sparkSession.sql(
        """SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty FROM {lines}
        WHERE l_linenumber = :line AND l_linestatus = :status GROUP BY l_returnflag""",
        args={"line": 3, "status": "F"},
        lines=lineitem,
    )


@query("filter_not_null", "D_results", sql="SELECT student_id, domain, raw_score FROM D_results WHERE raw_score IS NOT NULL")
def filter_not_null(results):
    return results.filter(F.col("raw_score").isNotNull()).select("student_id", "domain", "raw_score")


@query("filter_in", "orders", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def filter_in(orders):
    return orders.filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query("filter_not_equal", "orders", sql="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def filter_not_equal(orders):
    return orders.filter(F.col("o_orderpriority") != F.lit("5-LOW")).select("o_orderkey", "o_orderpriority")


@query(
    "conditional_update",
    "D_results",
    sql="""SELECT student_id, CASE WHEN domain = '1-URGENT' THEN 0.0::DOUBLE ELSE raw_score END AS raw_score,
  CASE WHEN domain = '1-URGENT' THEN 0.0::DOUBLE ELSE scaled_score END AS scaled_score FROM D_results""",
)
def conditional_update(results):
    hit = F.col("domain") == "1-URGENT"
    return results.withColumns({c: F.when(hit, 0.0).otherwise(F.col(c)) for c in ("raw_score", "scaled_score")}).drop("domain")


@query("regex_columns", "D_items", sql="SELECT platform_id, L3Q01, L3Q26, L3Q27 FROM D_items")
def regex_columns(items):
    return items.select("platform_id", items.colRegex("`^L\\d+Q\\d+$`"))


@query("constant_columns", "D_criteria", sql="SELECT platform_id, wr_ideas, 'Writing' AS domain, 2024::BIGINT AS test_year FROM D_criteria")
def constant_columns(criteria):
    known = [c for c in ("wr_ideas", "wr_punctuation") if c in criteria.columns]
    year = F.lit(2024).cast("bigint")
    return criteria.select("platform_id", *known).withColumns({"domain": F.lit("Writing"), "test_year": year})


# --- joins ------------------------------------------------------------------------


@query(
    "join_inner_using",
    "orders",
    "customer",
    sql="""SELECT c_mktsegment, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def join_inner_using(orders, customer):
    joined = orders.withColumnRenamed("o_custkey", "c_custkey").join(customer, "c_custkey")
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "join_inner_broadcast",
    "customer",
    "nation",
    sql="SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0",
)
def join_inner_broadcast(customer, nation):
    # No hint: Catalyst broadcasts the dimension while its size allows, else sorts.
    named = nation.filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return customer.join(named, "c_nationkey").select("c_custkey", "n_name")


@query(
    "join_renamed_key",
    "D_criteria",
    "orders",
    sql="SELECT platform_id, wr_ideas, o_totalprice FROM D_criteria JOIN orders ON platform_id = o_orderkey",
)
def join_renamed_key(criteria, orders):
    return criteria.join(orders, criteria["platform_id"] == orders["o_orderkey"]).select("platform_id", "wr_ideas", "o_totalprice")


@query(
    "join_dictionary",
    "orders",
    sql="""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' WHEN '5-LOW' THEN 'later' END AS due FROM orders""",
)
def join_dictionary(orders):
    words = {"now": ("1-URGENT",), "soon": ("2-HIGH",), "later": ("5-LOW",)}
    return orders.select("o_orderkey", values.lookup(F.col("o_orderpriority"), words).alias("due"))


@query(
    "scalar_broadcast",
    "orders",
    sql="""WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, round((o_totalprice - mean) / sd, 6) AS z FROM orders, m""",
)
def scalar_broadcast(orders):
    one = orders.select(
        F.struct(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    ).scalar()
    return orders.select("o_orderkey", F.round((F.col("o_totalprice") - one["mean"]) / one["sd"], 6).alias("z"))


LOOKUP_SQL = """dims AS (SELECT year_level, domain, max(raw_score) AS max_raw FROM D_levels GROUP BY ALL),
lookup AS (SELECT year_level, domain, CAST(raw_score AS BIGINT) AS raw_score,
  round(250.0::DOUBLE + (year_level - 3) * 45.0 + ((1 / (1 + exp(-6.0::DOUBLE * (raw_score / max_raw - 0.5))) - 1 / (1 + exp(3.0::DOUBLE)))
    / (1 / (1 + exp(-3.0::DOUBLE)) - 1 / (1 + exp(3.0::DOUBLE)))) * 260.0, 1) AS scaled_score
  FROM (SELECT *, unnest(range(0, max_raw + 1)) AS raw_score FROM dims))"""
BAND_SQL = """CASE WHEN scaled_score IS NULL THEN NULL
  WHEN scaled_score - (250 + (year_level - 3) * 45) >= 215 THEN 'Exceeding' WHEN scaled_score - (250 + (year_level - 3) * 45) >= 165 THEN 'Strong'
  WHEN scaled_score - (250 + (year_level - 3) * 45) >= 110 THEN 'Approaching Expectations'
  WHEN scaled_score - (250 + (year_level - 3) * 45) >= 60 THEN 'Developing' ELSE 'Needs Additional Support' END"""


def lookup_of(levels):
    dims = levels.groupBy("year_level", "domain").agg(F.max("raw_score").alias("max_raw"))
    return stage(scores.score_map(dims), "lookup")


@query("score_map", "D_levels", sql=f"WITH {LOOKUP_SQL} SELECT * FROM lookup")
def score_map(levels):
    return lookup_of(levels)


@query(
    "join_lookup",
    "D_levels",
    sql=f"""WITH {LOOKUP_SQL} SELECT year_level, domain, raw_score, count(*) AS n, max(scaled_score) AS scaled_score
FROM D_levels LEFT JOIN lookup USING (year_level, domain, raw_score) GROUP BY ALL""",
)
def join_lookup(levels):
    scored = scores.attach_scaled(levels, lookup_of(levels))
    return scored.groupBy("year_level", "domain", "raw_score").agg(F.count("*").alias("n"), F.max("scaled_score").alias("scaled_score"))


@query(
    "bands",
    "D_levels",
    sql=f"""WITH s AS (SELECT year_level, domain, price / 150 AS scaled_score FROM D_levels)
SELECT year_level, {BAND_SQL} AS band, count(*) AS n FROM s GROUP BY ALL""",
)
def bands(levels):
    banded = scores.with_band(levels.withColumn("scaled_score", F.col("price") / 150))
    return banded.groupBy("year_level", "band").agg(F.count("*").alias("n"))


@query(
    "band_table",
    "D_levels",
    sql="""SELECT year_level, CASE WHEN price IS NOT NULL THEN concat('b', len(list_filter(range(1, 40), lambda i: price / 150 >= 20 * year_level + i * 12.5::DOUBLE))) END AS band, count(*) AS n
FROM D_levels GROUP BY ALL""",
)
def band_table(levels):
    """Forty bands a level, from a table."""
    cuts = levels.select("year_level").distinct().select("year_level", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    low = F.when(F.col("i") > 0, 20 * F.col("year_level") + 12.5 * F.col("i"))
    high = F.when(F.col("i") < 39, 20 * F.col("year_level") + 12.5 * (F.col("i") + 1))
    bands = cuts.select("year_level", low.alias("low"), high.alias("high"), F.concat(F.lit("b"), F.col("i").cast("string")).alias("band"))
    scored = levels.select("year_level", (F.col("price") / 150).alias("scaled_score"))
    banded = scores.with_band_table(scored, bands, "scaled_score", "year_level")
    return banded.groupBy("year_level", "band").agg(F.count("*").alias("n"))


@query(
    "conformance",
    "D_levels",
    sql=f"""WITH {LOOKUP_SQL},
r AS (SELECT year_level, domain, raw_score, scaled_score + CASE WHEN domain = 'R' AND raw_score = 7 THEN 1 ELSE 0 END AS scaled_score,
  CASE WHEN raw_score > 45 THEN 'Strong' ELSE {BAND_SQL} END AS proficiency FROM D_levels JOIN lookup USING (year_level, domain, raw_score)),
f AS (SELECT r.year_level, r.domain, r.raw_score, r.scaled_score, r.proficiency, l.raw_score IS NULL AS pair_unknown, r.proficiency IS DISTINCT FROM ({BAND_SQL.replace('scaled_score', 'r.scaled_score').replace('year_level', 'r.year_level')}) AS band_differs
  FROM r LEFT JOIN lookup l ON r.year_level = l.year_level AND r.domain = l.domain AND r.raw_score = l.raw_score AND r.scaled_score = l.scaled_score)
SELECT * FROM f WHERE pair_unknown OR band_differs""",
)
def conformance(levels):
    lookup = lookup_of(levels)
    scored = scores.with_band(scores.attach_scaled(levels.drop("price"), lookup))
    wrong = (F.col("domain") == "R") & (F.col("raw_score") == 7)
    delivered = scored.select(
        "year_level", "domain", "raw_score",
        (F.col("scaled_score") + F.when(wrong, 1).otherwise(0)).alias("scaled_score"),
        F.when(F.col("raw_score") > 45, "Strong").otherwise(F.col("band")).alias("proficiency"),
    )
    return scores.nonconforming(delivered, lookup)


@query(
    "dense_grid",
    "orders",
    sql="""WITH g AS (SELECT c AS o_custkey, d AS domain FROM (SELECT DISTINCT o_custkey AS c FROM orders),
  (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS v(d))
SELECT o_custkey, domain FROM g WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = g.o_custkey AND o.o_orderpriority = g.domain)""",
)
def dense_grid(orders):
    grid = scores.dense_grid(orders, "o_custkey", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    seen = orders.select("o_custkey", F.col("o_orderpriority").alias("domain")).distinct()
    return grid.join(seen, ["o_custkey", "domain"], "left_anti")


@query(
    "semi_members",
    "customer",
    "orders",
    sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def semi_members(customer, orders):
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "anti_members",
    "customer",
    "orders",
    sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def anti_members(customer, orders):
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    return rows.exclude_members(customer, "c_custkey", urgent, "o_custkey").select("c_custkey", "c_name")


# --- aggregates -------------------------------------------------------------------


@query(
    "group_spread",
    "lineitem",
    sql="""SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
  round(var_samp(l_quantity), 6) AS var_qty, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS std_error FROM lineitem GROUP BY l_suppkey""",
)
def group_spread(lineitem):
    sd = F.stddev_samp("l_extendedprice")
    return lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"),
        F.round(sd, 4).alias("sd"),
        F.round(F.var_samp("l_quantity"), 6).alias("var_qty"),
        F.round(sd / F.sqrt(F.count("*")), 4).alias("std_error"),
    )


GROUPS_SQL = "g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_suppkey)"


@query(
    "weighted_pooled",
    "lineitem",
    sql=f"""WITH {GROUPS_SQL} SELECT round(sum(n * mean) / sum(n), 6) AS grand_mean,
  round(sum((n - 1) * v) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1), 6) AS pooled_variance FROM g""",
)
def weighted_pooled(lineitem):
    parts = groups.variance_parts(groups.group_moments(lineitem, ["l_suppkey"], "l_quantity"))
    return parts.select(F.round("grand_mean", 6).alias("grand_mean"), F.round("sigma2", 6).alias("pooled_variance"))


@query(
    "means_variance",
    "lineitem",
    sql=f"WITH {GROUPS_SQL} SELECT round(var_samp(mean), 6) AS variance_of_means, round(avg(1.0::DOUBLE / n), 9) AS mean_inverse_n FROM g",
)
def means_variance(lineitem):
    moments = groups.group_moments(lineitem, ["l_suppkey"], "l_quantity")
    return moments.agg(
        F.round(F.var_samp("mean"), 6).alias("variance_of_means"), F.round(F.avg(1 / F.col("n")), 9).alias("mean_inverse_n")
    )


@query(
    "ols_fit",
    "D_scripts",
    sql="SELECT round(regr_slope(writing_raw, ability), 12) AS slope, round(regr_intercept(writing_raw, ability), 6) AS intercept FROM D_scripts",
)
def ols_fit(scripts):
    return scripts.agg(
        F.round(F.regr_slope("writing_raw", "ability"), 12).alias("slope"),
        F.round(F.regr_intercept("writing_raw", "ability"), 6).alias("intercept"),
    )


@query(
    "median_mad",
    "orders",
    sql="""WITH m AS (SELECT median(o_totalprice) AS med FROM orders)
SELECT round((SELECT med FROM m), 4) AS median, round(median(abs(o_totalprice - med)), 4) AS mad FROM orders, m""",
)
def median_mad(orders):
    median = F.lit(ranking.median_of(orders, "o_totalprice")[0]).cast("double")
    distance = orders.select(F.abs(F.col("o_totalprice") - median).alias("d"))
    return ranking.exact_median(distance, "d").select(F.round(median, 4).alias("median"), F.round("median", 4).alias("mad"))


@query("group_sum", "lineitem", sql="SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey")
def group_sum(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@query("first_value", "lineitem", sql="SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey")
def first_value(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"))


@query(
    "share_counts",
    "D_results",
    sql="""SELECT domain, count(*) FILTER (WHERE raw_score = 0) AS n_zero, count(raw_score) AS n_scored,
  round(100.0::DOUBLE * count(*) FILTER (WHERE raw_score IS NULL) / count(*), 6) AS pct_missing FROM D_results GROUP BY domain""",
)
def share_counts(results):
    missing = F.count_if(F.col("raw_score").isNull())
    return results.groupBy("domain").agg(
        F.count_if(F.col("raw_score") == 0).alias("n_zero"),
        F.count("raw_score").alias("n_scored"),
        F.round(100.0 * missing / F.count("*"), 6).alias("pct_missing"),
    )


@query(
    "mode_by_group",
    "D_orders",
    sql="""WITH c AS (SELECT status, regexp_replace(regexp_replace(date_raw, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n FROM D_orders GROUP BY ALL)
SELECT status, shape FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, shape) AS pick FROM c) WHERE pick = 1""",
)
def mode_by_group(orders):
    counts = orders.groupBy("status", naming.fingerprint(F.col("date_raw")).alias("shape")).agg(F.count("*").alias("n"))
    return counts.groupBy("status").agg(F.min_by("shape", F.struct(-F.col("n"), F.col("shape"))).alias("shape"))


@query("distinct_values", "lineitem", sql="SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(lineitem):
    return lineitem.select("l_returnflag", "l_linestatus").distinct()


@query(
    "summary_stats",
    "orders",
    sql="""SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
  min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""",
)
def summary_stats(orders):
    return ranking.summary_stats(orders, "o_totalprice").withColumns({c: F.round(c, 4) for c in ("mean", "std")})


# --- order and limits -------------------------------------------------------------


@query(
    "order_nulls_last",
    "D_customer",
    sql="""SELECT c_custkey, balance, CAST(row_number() OVER (ORDER BY balance DESC NULLS LAST, c_custkey) AS BIGINT) AS place
FROM (SELECT c_custkey, TRY_CAST(balance_raw AS DOUBLE) AS balance FROM D_customer)""",
)
def order_nulls_last(dirty):
    numbers = dirty.select("c_custkey", values.coerce_numeric(F.col("balance_raw")).alias("balance"))
    return ranking.global_row_number(numbers, F.desc_nulls_last("balance"), F.col("c_custkey"), name="place")


@query(
    "top_k",
    "customer",
    sql="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
)
def top_k(customer):
    return ranking.top_k(customer.select("c_custkey", "c_acctbal"), 10, F.desc("c_acctbal"), F.col("c_custkey"))


@query(
    "row_cap",
    "orders",
    sql="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 1000",
)
def row_cap(orders):
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return questions.capped(counted.orderBy(F.desc("n"), "o_custkey"))


@query(
    "first_examples",
    "D_orders",
    sql="SELECT DISTINCT date_raw, status FROM D_orders ORDER BY date_raw, status LIMIT 5",
)
def first_examples(orders):
    return ranking.top_k(orders.select("date_raw", "status").distinct(), 5, F.col("date_raw"), F.col("status"))


# --- sets -------------------------------------------------------------------------


@query(
    "union_all",
    "customer",
    "supplier",
    sql="""SELECT c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer
UNION ALL SELECT s_name, s_acctbal, s_nationkey FROM supplier""",
)
def union_all(customer, supplier):
    a = customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    b = supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query("intersect_values", "orders", "customer", sql="SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def intersect_values(orders, customer):
    return orders.select(F.col("o_custkey").alias("k")).intersect(customer.select(F.col("c_custkey").alias("k")))


@query(
    "token_jaccard",
    "conversations",
    sql=r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) END AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def token_jaccard(conversations):
    words = conversations.select("conv_id", "turn", question_words(F.col("text")).alias("w"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    return words.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(naming.jaccard(F.col("w"), F.col("next")), 6).alias("jaccard")
    )


@query(
    "disjoint_check",
    "lineitem",
    sql="""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT count(*) AS shared FROM (SELECT l_suppkey FROM g WHERE n >= 600 INTERSECT SELECT l_suppkey FROM g WHERE n < 600)""",
)
def disjoint_check(lineitem):
    counts = lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    many, few = counts.filter("n >= 600"), counts.filter("n < 600")
    return many.select("l_suppkey").intersect(few.select("l_suppkey")).agg(F.count("*").alias("shared"))
