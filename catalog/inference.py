"""Prepared aggregates, gaps, rankings, shrinkage, marker review and item response fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fits
from catalog.registry import query
from tally.functions.inference import t_quantile, t_terms
from tally.operators import groups, irt, markers, ranking
from tally.plans import questions, vendor
from tally.session import stage

ANSWER_ITEMS = [f"N3Q0{i}" for i in range(1, 8)]

# --- prepared aggregates ------------------------------------------------------------


@query(
    "avg_by_level",
    "lineitem",
    sql="""SELECT l_linenumber, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem
WHERE l_returnflag = 'R' AND l_extendedprice IS NOT NULL GROUP BY l_linenumber""",
)
def avg_by_level(lineitem):
    returned = lineitem.filter("l_returnflag = 'R'")
    return questions.average_by(returned, ["l_linenumber"], "l_extendedprice", "avg_price", 4)


@query(
    "top_groups",
    "orders",
    "customer",
    sql="""SELECT c_name, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_total, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name HAVING count(*) >= 20 ORDER BY avg_total DESC, c_name LIMIT 10""",
)
def top_groups(orders, customer):
    keyed = orders.withColumnRenamed("o_custkey", "c_custkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    top = questions.top_groups(keyed, customer, "c_custkey", "c_name", price, "avg_total", digits=4)
    return top.withColumn("avg_total", F.col("avg_total").cast("double"))


@query(
    "avg_by_group",
    "orders",
    "customer",
    sql="""SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment, round(avg(o_totalprice), 4) AS avg_total, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""",
)
def avg_by_group(orders, customer):
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    joined = urgent.join(customer.select("c_custkey", segment), "c_custkey")
    return questions.average_by(joined, ["segment"], "o_totalprice", "avg_total", 4)


@query(
    "avg_by_domain",
    "D_results",
    sql="""SELECT domain, round(avg(raw_score), 4) AS avg_score, count(*) AS n FROM D_results WHERE raw_score IS NOT NULL GROUP BY domain""",
)
def avg_by_domain(results):
    return questions.average_by(results, ["domain"], "raw_score", "avg_score", 4)


@query(
    "band_counts",
    "orders",
    sql="SELECT o_orderpriority, count(*) AS students FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority",
)
def band_counts(orders):
    return questions.band_counts(orders.filter("o_orderstatus = 'F'"), "o_orderpriority")


@query(
    "distinct_by_group",
    "orders",
    "customer",
    sql="SELECT c_mktsegment, count(DISTINCT o_orderpriority || o_orderstatus) AS kinds FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def distinct_by_group(orders, customer):
    kinds = orders.select(F.col("o_custkey").alias("c_custkey"), F.concat("o_orderpriority", "o_orderstatus").alias("kind"))
    return questions.distinct_by_group(kinds, customer, "c_custkey", "c_mktsegment", "kind", "kinds")


@query(
    "distinct_members",
    "lineitem",
    "supplier",
    sql="SELECT s_nationkey, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey",
)
def distinct_members(lineitem, supplier):
    facts = lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    return questions.distinct_by_group(facts, supplier, "s_suppkey", "s_nationkey", "l_orderkey", "orders")


# --- group comparisons ----------------------------------------------------------------

# The groups of this gap have thousands of rows, where the expansion is exact far beyond the decimals compared.
_T = t_terms(0.95)
T_SQL = "(" + " + ".join(f"{term!r}::DOUBLE" + " / df" * i for i, term in enumerate(_T)) + ")"


@query(
    "mean_gap",
    "lineitem",
    sql=f"""WITH s AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS mean_a,
  stddev_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS sd_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b,
  avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS mean_b, stddev_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS sd_b
  FROM lineitem GROUP BY l_returnflag),
d AS (SELECT *, mean_a - mean_b AS difference, sqrt(sd_a * sd_a / n_a + sd_b * sd_b / n_b) AS se,
  pow(sd_a * sd_a / n_a + sd_b * sd_b / n_b, 2) / (pow(sd_a * sd_a / n_a, 2) / (n_a - 1) + pow(sd_b * sd_b / n_b, 2) / (n_b - 1)) AS df FROM s),
c AS (SELECT *, difference - {T_SQL} * se AS ci_low, difference + {T_SQL} * se AS ci_high FROM d)
SELECT l_returnflag, 'F' AS group_a, 'O' AS group_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, n_a, n_b, round(difference, 4) AS difference,
  round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, NOT (ci_low <= 0 AND ci_high >= 0) AS is_significant,
  CASE WHEN NOT (ci_low <= 0 AND ci_high >= 0)
    THEN printf('A gap of %+.1f points (95%% CI [%.1f, %.1f]) excludes zero; beside a spread of ~%.0f points it is detectable but modest.', difference, ci_low, ci_high, (sd_a + sd_b) / 2)
    ELSE printf('A gap of %+.1f points (95%% CI [%.1f, %.1f]) includes zero; beside a spread of ~%.0f points it is noise, no real difference.', difference, ci_low, ci_high, (sd_a + sd_b) / 2) END AS interpretation
FROM c""",
)
def mean_gap(lineitem):
    gap = groups.mean_gap(lineitem, "l_linestatus", "F", "O", "l_extendedprice", ["l_returnflag"])
    rounded = ("mean_a", "mean_b", "difference", "ci_low", "ci_high")
    return gap.withColumns({c: F.round(c, 4) for c in rounded})


CONFIDENCES = (0.8, 0.95, 0.99)


# The twin halves an angle: for whole degrees of freedom the chance inside is a finite sum over its cosine.
@query(
    "t_quantiles",
    "part",
    sql=f"""WITH RECURSIVE v AS (SELECT DISTINCT CAST(unnest([p_size, 20 * p_size]) AS BIGINT) AS v FROM part),
coef AS (SELECT k, exp(sum(CASE WHEN k < 2 THEN 0::DOUBLE ELSE ln((k - 1)::DOUBLE / k) END) OVER (PARTITION BY k % 2 ORDER BY k)) AS c FROM (SELECT unnest(range(0, 1000)) AS k)),
b AS (
  SELECT v, p, 0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS r FROM v CROSS JOIN (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in CONFIDENCES)}]) AS p)
  UNION ALL
  SELECT v, p, CASE WHEN inside < p THEN mid ELSE lo END, CASE WHEN inside < p THEN hi ELSE mid END, r + 1
  FROM (SELECT v, p, lo, hi, r, mid, CASE WHEN v % 2 = 1 THEN 2 / pi() * (mid + sin(mid) * coalesce(sum(c * cos(mid) ** k), 0)) ELSE sin(mid) * sum(c * cos(mid) ** k) END AS inside
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE r < 60) LEFT JOIN coef ON k % 2 = v % 2 AND k <= v - 2 GROUP BY v, p, lo, hi, r, mid)
)
SELECT v AS df, p AS confidence, round(sqrt(v) * tan((lo + hi) / 2), 6) AS t FROM b WHERE r = 60""",
)
def t_quantiles(part):
    """Two-sided Student quantiles for small and large degrees of freedom."""
    df = part.select(F.explode(F.array("p_size", 20 * F.col("p_size")).cast("array<bigint>")).alias("df")).distinct()
    each = [F.struct(F.lit(c).alias("confidence"), F.round(t_quantile(F.col("df"), c), 6).alias("t")) for c in CONFIDENCES]
    return df.select("df", F.inline(F.array(*each)))


SUPPLIER_SQL = """SELECT s_name AS school_name, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, var_samp(l_extendedprice) AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name"""


def supplier_moments(lineitem, supplier):
    dims = supplier.select(F.col("s_suppkey").alias("school_id"), F.col("s_name").alias("school_name"))
    return groups.school_moments(lineitem.withColumnRenamed("l_suppkey", "school_id"), dims, "l_extendedprice")


@query(
    "group_ranking",
    "lineitem",
    "supplier",
    sql=f"""WITH g AS ({SUPPLIER_SQL}) SELECT school_name, CAST(n AS BIGINT) AS n, round(mean, 1) AS mean,
  CASE WHEN n >= 600 THEN round(sd / sqrt(n), 1) END AS std_error, CASE WHEN n >= 600 THEN 'reliable' ELSE 'flagged' END AS status FROM g""",
)
def group_ranking(lineitem, supplier):
    return groups.group_ranking(supplier_moments(lineitem, supplier), ["school_name"], min_n=600)


@query(
    "reliable_groups",
    "lineitem",
    "supplier",
    sql=f"""WITH g AS ({SUPPLIER_SQL}) SELECT school_name, CAST(n AS BIGINT) AS n, round(mean, 1) AS mean,
  round(sd / sqrt(n), 1) AS std_error FROM g WHERE n >= 600""",
)
def reliable_groups(lineitem, supplier):
    return groups.reliable_groups(group_ranking(lineitem, supplier), ["school_name"])


@query(
    "flagged_groups",
    "lineitem",
    "supplier",
    sql=f"""WITH g AS ({SUPPLIER_SQL}) SELECT school_name, CAST(n AS BIGINT) AS n, round(mean, 1) AS mean FROM g WHERE n < 600""",
)
def flagged_groups(lineitem, supplier):
    return groups.flagged_groups(group_ranking(lineitem, supplier), ["school_name"])


@query(
    "shrinkage",
    "lineitem",
    "supplier",
    sql=f"""WITH g AS ({SUPPLIER_SQL}),
p AS (SELECT sum(n * mean) / sum(n) AS grand, sum((n - 1) * v) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1) AS sigma2,
  var_samp(mean) AS observed, avg(1.0::DOUBLE / n) AS inv FROM g),
w AS (SELECT g.*, grand, sigma2, greatest(observed - sigma2 * inv, 1.0) AS tau2, greatest(observed - sigma2 * inv, 1.0) / (greatest(observed - sigma2 * inv, 1.0) + sigma2 / n) AS weight FROM g, p)
SELECT school_name, CAST(n AS BIGINT) AS n, round(mean, 1) AS raw_mean, round(weight * mean + (1 - weight) * grand, 1) AS shrunk_estimate,
  round(weight, 3) AS reliability, round(mean - (weight * mean + (1 - weight) * grand), 1) + 0.0 AS pulled_by FROM w""",
)
def shrinkage(lineitem, supplier):
    return groups.shrink_means(supplier_moments(lineitem, supplier), ["school_name"])


@query(
    "marker_review",
    "D_scripts",
    sql="""WITH f AS (SELECT regr_slope(writing_raw, ability) AS slope, regr_intercept(writing_raw, ability) AS intercept FROM D_scripts),
r AS (SELECT marker_id, writing_raw - (slope * ability + intercept) AS residual FROM D_scripts, f),
s AS (SELECT marker_id AS marker, count(*) AS n_scripts, round(avg(residual), 2) + 0.0 AS mean_residual, round(stddev_samp(residual) / sqrt(count(*)), 3) AS std_error FROM r GROUP BY marker_id),
m AS (SELECT median(mean_residual) AS med FROM s),
d AS (SELECT CASE WHEN median(abs(mean_residual - med)) = 0 THEN 1e-9 ELSE median(abs(mean_residual - med)) END AS mad FROM s, m),
v AS (SELECT s.*, med, round((mean_residual - med) / (1.4826 * mad), 1) + 0.0 AS severity_score FROM s, m, d)
SELECT CAST(row_number() OVER (ORDER BY abs(severity_score) DESC, marker) AS BIGINT) AS review_rank, marker, n_scripts, mean_residual, std_error, severity_score,
  CASE WHEN abs(severity_score) > 3.5 THEN CASE WHEN mean_residual < med THEN 'harsh' ELSE 'lenient' END ELSE 'ok' END AS flag FROM v""",
)
def marker_review(scripts):
    return markers.marker_review(scripts, "marker_id", "writing_raw", "ability")


@query(
    "review_rank",
    "orders",
    sql="""WITH c AS (SELECT o_custkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM orders GROUP BY o_custkey)
SELECT o_custkey, total, CAST(row_number() OVER (ORDER BY total DESC, o_custkey) AS BIGINT) AS review_rank FROM c""",
)
def review_rank(orders):
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2)
    totals = orders.groupBy("o_custkey").agg(total.alias("total"))
    return ranking.global_row_number(totals, F.desc("total"), F.col("o_custkey"), name="review_rank")


# --- item response ------------------------------------------------------------------


def answers_of(frame):
    return frame.select("platform_id", "segment", irt.pattern_of(ANSWER_ITEMS).alias("pattern"))


@query(
    "response_patterns",
    "D_answers",
    sql="SELECT segment, concat(" + ", ".join(ANSWER_ITEMS) + ") AS pattern, count(*) AS n FROM D_answers GROUP BY ALL",
)
def response_patterns(frame):
    return irt.response_patterns(answers_of(frame), ["segment"])


ANSWER_PATTERNS = "SELECT segment AS key, concat(" + ", ".join(ANSWER_ITEMS) + ") AS pattern, count(*) AS n FROM D_answers GROUP BY ALL"
ITEMS_SQL = fits.fit_sql(
    ANSWER_PATTERNS, "SELECT key AS segment, concat('N3Q0', item) AS item, round(b, 3) AS difficulty, round(a, 3) AS discrimination FROM fits"
)


def fitted(frame, form="grouped"):
    answers = stage(answers_of(frame), "answers")
    patterns = stage(irt.response_patterns(answers, ["segment"]), "patterns")
    return answers, patterns, irt.fit_groups(patterns, ["segment"], form)


@query("irt_items", "D_answers", sql=ITEMS_SQL)
def irt_items(frame):
    return irt.item_parameters(fitted(frame)[2], ANSWER_ITEMS, ["segment"])


@query("irt_items_summed", "D_answers", sql=ITEMS_SQL)
def irt_items_summed(frame):
    """The same fit from counts that Spark sums each round, its state in a table."""
    return irt.item_parameters(fitted(frame, "summed")[2], ANSWER_ITEMS, ["segment"])


@query(
    "irt_expectation",
    "D_answers",
    sql=fits.fit_sql(
        ANSWER_PATTERNS,
        f"""SELECT w.key AS segment, w.j AS node, marks.item - 1 AS item, round(sum(w.n * w), 6) AS persons, round(sum(w.n * w * mark), 6) AS "right"
FROM {fits.START_WEIGHTS} AS w JOIN marks ON w.key = marks.key AND w.pid = marks.pid GROUP BY ALL""",
    ),
)
def irt_expectation(frame):
    """Expected persons and right answers at each node, one step from the starting values."""
    step = irt.expectation_step(irt.response_patterns(answers_of(frame), ["segment"]), ["segment"])
    return step.withColumns({c: F.col(c).cast("bigint") for c in ("node", "item")})


@query(
    "irt_statistics",
    "D_answers",
    sql=fits.fit_sql(
        ANSWER_PATTERNS,
        f"""SELECT key AS segment, CAST(sum(n) AS BIGINT) AS n_persons, round(28 - 2 * sum(n * ll), 1) AS aic, round(14 * ln(sum(n)) - 2 * sum(n * ll), 1) AS bic
FROM (SELECT DISTINCT key, pid, n, ll FROM {fits.WEIGHTS} WHERE j = 0) GROUP BY key""",
    ),
)
def irt_statistics(frame):
    return irt.fit_statistics(fitted(frame)[2], ["segment"])


@query(
    "irt_ability",
    "D_answers",
    sql=fits.fit_sql(
        ANSWER_PATTERNS,
        f"""SELECT platform_id, segment, ability
FROM (SELECT platform_id, segment, concat({", ".join(ANSWER_ITEMS)}) AS pid FROM D_answers) AS a
JOIN (SELECT key, pid, round(sum(w * x), 4) AS ability FROM {fits.WEIGHTS} JOIN nodes USING (j) GROUP BY key, pid) AS k
  ON a.segment = k.key AND a.pid = k.pid""",
    ),
)
def irt_ability(frame):
    answers, patterns, fitted_groups = fitted(frame)
    known = irt.pattern_abilities(patterns, fitted_groups, ["segment"])
    return irt.person_abilities(answers, known.withColumn("ability", F.round("ability", 4)), "platform_id", ["segment"])


@query(
    "spaced_abilities",
    "D_answers",
    sql=fits.fit_sql(
        ANSWER_PATTERNS.replace("segment AS key", "'all' AS key"),
        f"""SELECT platform_id, ability, rank, position FROM (
WITH people AS (SELECT platform_id, ability FROM (SELECT platform_id, concat({", ".join(ANSWER_ITEMS)}) AS pid FROM D_answers) JOIN
  (SELECT pid, round(sum(w * x), 4) AS ability FROM {fits.WEIGHTS} JOIN nodes USING (j) GROUP BY pid) USING (pid)),
sizes AS (SELECT ability, count(*) AS n FROM people GROUP BY ability),
upto AS (SELECT ability, n, sum(n) OVER (ORDER BY ability DESC) - n AS before, sum(n) OVER () AS total FROM sizes),
places AS (SELECT CAST(floor(i * (total - 1) / 7) AS BIGINT) AS place, total FROM (SELECT any_value(total) AS total FROM upto), (SELECT unnest(range(0, 8)) AS i)),
met AS (SELECT place, ability, places.total, row_number() OVER (PARTITION BY ability ORDER BY place) AS turn FROM places JOIN upto ON place >= before AND place < before + n),
first AS (SELECT *, row_number() OVER (PARTITION BY ability ORDER BY platform_id) AS turn FROM people)
SELECT platform_id, ability, place + 1 AS rank, concat(format('{{:,}}', place + 1), ' of ', format('{{:,}}', CAST(total AS BIGINT))) AS position FROM met JOIN first USING (ability, turn))""",
    ),
)
def spaced_abilities(frame):
    """Eight persons evenly spread over the ranking by ability, found from the patterns."""
    answers = stage(answers_of(frame).drop("segment"), "answers")
    patterns = stage(irt.response_patterns(answers), "patterns")
    known = irt.pattern_abilities(patterns, irt.fit_groups(patterns)).withColumn("ability", F.round("ability", 4))
    return ranking.spaced_groups(known, irt.person_abilities(answers, known, "platform_id"), "ability", "platform_id")


# Three levels with two domains each: the first four items as numeracy, the last four as reading.
GRID_LEVELS = {3: "F", 5: "O", 7: "P"}
GRID_PATTERNS = " UNION ALL ".join(
    f"SELECT concat('{level} ', '{domain}') AS key, concat({', '.join(columns)}) AS pattern, count(*) AS n FROM D_answers WHERE segment = '{segment}' GROUP BY ALL"
    for level, segment in GRID_LEVELS.items()
    for domain, columns in (("Numeracy", ANSWER_ITEMS[:4]), ("Reading", ANSWER_ITEMS[3:]))
)


@query(
    "irt_grid",
    "D_answers",
    sql=fits.fit_sql(
        GRID_PATTERNS,
        """SELECT CAST(split_part(key, ' ', 1) AS BIGINT) AS year_level, split_part(key, ' ', 2) AS domain,
  concat(left(split_part(key, ' ', 2), 1), '3Q0', item) AS item, round(b, 3) AS difficulty, round(a, 3) AS discrimination FROM fits""",
    ),
)
def irt_grid(frame):
    """Every level by domain of a feed, fitted side by side."""
    feed = frame.select("platform_id", "segment", *ANSWER_ITEMS[:4], *[F.col(c).alias(f"R3Q0{i}") for i, c in enumerate(ANSWER_ITEMS[3:], 1)])
    # A feed arrives as files; from the query each level would make all of it again, in one task with the others.
    feed = stage(feed, "feed", narrow=True)
    levels = {level: feed.filter(F.col("segment") == s).drop("segment") for level, s in GRID_LEVELS.items()}
    return vendor.fit_paper(levels, "platform_id")["items"]


@query(
    "ability_histogram",
    "orders",
    sql="""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT CAST(least(8, floor((o_totalprice - lo) / (hi - lo) * 8) + 1) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY ALL)
SELECT b.bin, round(lo + (b.bin - 0.5::DOUBLE) * (hi - lo) / 8, 2) AS midpoint, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 9)) AS bin) AS b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
)
def ability_histogram(orders):
    return ranking.histogram(orders, "o_totalprice", 8)


@query(
    "spaced_rank",
    "orders",
    sql="""WITH r AS (SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, count(*) OVER () AS total FROM orders),
p AS (SELECT unnest(range(0, 8)) AS i)
SELECT o_orderkey, o_totalprice, rank, concat(format('{:,}', rank), ' of ', format('{:,}', total)) AS position
FROM r WHERE rank - 1 IN (SELECT CAST(floor(i * (total - 1) / 7) AS BIGINT) FROM p)""",
)
def spaced_rank(orders):
    return ranking.spaced_sample(orders.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"))
