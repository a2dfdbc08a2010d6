"""Quality rules, line first: judge every line, drop the failing ones, reject a text that loses too much.

Only Column expressions; no row leaves its task and nothing is shuffled.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated
rows are judged alike, each on its own; an empty table gives an empty table. Other columns of the
input are not read, so their names may clash with the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import space_words, table
from tally.llm.registry import query

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A line fails where symbols or runs of exclamation marks come to half its words,
MAX_MARKS_PERCENT = 50
# where bars, arrows and bullets stand between most of its words (a menu),
MAX_SEPARATOR_PERCENT = 30
# or where it says what sites say everywhere.
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|"
    r"enable javascript|sign in to|log in to|subscribe to|click here|back to top|skip to content"
)
MAX_LOST_PERCENT = 50


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _judged_line(line: Column) -> Column:
    words = F.size(space_words(line))
    marks = _count(line, r"[#*$%&|<>{}\[\]~^=\\]|!!+|\?\?+")
    separators = _count(line, "[|>\u00bb\u203a\u00b7\u2022]")
    letters = line.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return F.struct(
        line.alias("line"),
        words.alias("words"),
        (100 * marks >= MAX_MARKS_PERCENT * words).alias("punctuation"),
        ((separators >= 2) & (100 * separators >= MAX_SEPARATOR_PERCENT * words)).alias("navigation"),
        (line.rlike(BOILERPLATE) | ~letters).alias("boilerplate"),
    )


def judge_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: the base counts, the line counts, the cleaned text and both verdicts.

    ``clean_text`` holds the lines that pass (and the empty ones between them), joined as they stood.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    df = df.select("__id", text.alias("__text"))
    df = df.select(
        "__id",
        "__text",
        F.transform(space_words(F.col("__text")), lambda w: F.xxhash64(w)).alias("__w"),
        F.transform(F.split("__text", "\n"), _judged_line).alias("__lines"),
    )
    w = F.col("__w")
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i")),
    )
    df = df.select(
        "__id",
        F.size(w).cast("long").alias("n_words"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.filter("__lines", lambda x: x["words"] > 0).alias("__full"),
        "__lines",
        # sort_array compares in the JVM's own order; array_sort evaluates an expression for each comparison.
        F.sort_array(windows).alias("__s"),
    )
    s = F.col("__s")
    twice = F.filter(
        F.transform(
            s,
            lambda x, i: F.when(
                (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
            ),
        ),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("__at", F.sort_array(twice)).drop("__s")
    n_repeat = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )

    def failed(x: Column) -> Column:
        return (x["words"] > 0) & (x["punctuation"] | x["navigation"] | x["boilerplate"])

    def in_lines(rule: str) -> Column:
        return F.size(F.filter("__full", lambda x: x[rule])).cast("long")

    lost = F.aggregate(F.filter("__full", failed), F.lit(0), lambda a, x: a + x["words"])
    distinct_lines = F.size(F.array_distinct(F.transform("__full", lambda x: x["line"])))
    df = df.select(
        "__id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__full") - distinct_lines).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        in_lines("punctuation").alias("n_punctuation_lines"),
        in_lines("navigation").alias("n_navigation_lines"),
        in_lines("boilerplate").alias("n_boilerplate_lines"),
        lost.cast("long").alias("lost_words"),
        F.array_join(
            F.transform(F.filter("__lines", lambda x: ~failed(x)), lambda x: x["line"]), "\n"
        ).alias("clean_text"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    df = df.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words"))
    return df.withColumn("kept", kept).withColumnRenamed("__id", id_col)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             string_split(t, chr(10)) AS lines FROM d),
n AS (SELECT doc_id, t, w, len(w) AS n_words, lines,
             [list_aggregate(w[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(w) - 3)] AS win FROM w),
pos AS (SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS i FROM n WHERE len(win) > 0),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM pos) WHERE c > 1),
gaps AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS r FROM gaps GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM n),
lw AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k,
              len(regexp_extract_all(line, '[#*$%&|<>{}\[\]~^=\\]|!!+|\?\?+')) AS marks,
              len(regexp_extract_all(line, '[|>»›·•]')) AS seps,
              regexp_matches(line, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS letters,
              regexp_matches(line, '(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript|sign in to|log in to|subscribe to|click here|back to top|skip to content') AS plate
       FROM l),
lj AS (SELECT doc_id, line, k, 100 * marks >= 50 * k AS p, seps >= 2 AND 100 * seps >= 30 * k AS v,
              plate OR NOT letters AS b FROM lw WHERE k > 0),
la AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (p) AS np, count(*) FILTER (v) AS nv,
              count(*) FILTER (b) AS nb, sum(CASE WHEN p OR v OR b THEN k ELSE 0 END) AS lost FROM lj GROUP BY doc_id),
j AS (SELECT n.doc_id, n_words::BIGINT AS n_words,
             length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
             coalesce(np, 0)::BIGINT AS n_punctuation_lines, coalesce(nv, 0)::BIGINT AS n_navigation_lines,
             coalesce(nb, 0)::BIGINT AS n_boilerplate_lines, coalesce(lost, 0)::BIGINT AS lost_words
      FROM n LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM j
"""


@query("op8_quality_rules", SQL)
def op8_quality_rules(spark, sf_dir):
    return judge_documents(table(spark, sf_dir, "documents")).drop("clean_text")
