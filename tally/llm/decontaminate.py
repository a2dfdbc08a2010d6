"""Benchmark decontamination as a prefix-filtered set join with exact containment.

A window is ``WINDOW`` consecutive words of a benchmark item (the whole of a shorter one). Containing
a window means containing all its shingles, so one shingle of each window is enough as its prefix,
and the rarest in the corpus is taken. Documents are read once: shingles that may belong to the
benchmark are kept with the words around them (a bitmap of fixed size decides, false positives only);
counts, prefix choice, join, position and length bounds and the word-by-word check run on those.

Only DataFrame and Column operations on rows. Hot shingles are counted before they are shuffled, and
their join is left to adaptive skew splitting; nothing pairs documents with documents.

Defined results: null and empty texts have no words and are clean; empty items and null texts in the
benchmark are no items, items with a null id count as hits but are not listed; equal rows get equal
results; an empty benchmark leaves all clean; an empty table gives an empty table. Other columns are
not read, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import ALNUM_WORD, bitmap_words, lower_ascii, table
from tally.llm.registry import query
from tally.session import stage

WINDOW = 13
SHINGLE = 3
# Of the documents' shingles that are not the benchmark's, at most shingles / 2**bits pass the bitmap.
BITMAP_BITS = 22
MIN_HIT_SHARE = 20


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _shingle(words: Column, first: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), first, *[F.get(words, i + k) for k in range(1, width)])


def _shingles(words: Column, width: int) -> Column:
    """Shingle hashes by position; those that would run over the end are no shingles and match nothing real."""
    return F.transform(words, lambda x, i: _shingle(words, x, i, width))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (``item, window``): the distinct word windows of each item."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(WINDOW)))
    return items.select("item", F.explode(windows).alias("window")).distinct()


def _maybe_listed(h: Column, bitmap: DataFrame) -> Column:
    """Whether the bitmap has the bit of ``h``; the bitmap is one array of fixed length."""
    words = 1 << (BITMAP_BITS - 6)
    every = bitmap.sparkSession.range(words).withColumnRenamed("id", "at").join(bitmap, "at", "left")
    bits = F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]
    )
    array = every.agg(bits.alias("bitmap")).scalar()
    slot = h.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    word = F.element_at(array, (F.shiftright(slot, 6) + 1).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int"))
    return bit.bitwiseAND(F.lit(1).cast("long")) == 1


def _candidates(documents: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """One row per document at ``at`` 0, and one per place whose shingle may be the benchmark's, with its surroundings."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("w"))
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    mark = F.array(F.lit(0).cast("long"))
    w = F.col("w")
    placed = F.concat(mark, *[_shingles(w, width) for width in widths]) if widths else mark
    rows = docs.select("doc_id", "text_hash", "n_words", "w", F.posexplode(placed).alias("at", "h"))
    rows = rows.where((F.col("at") == 0) | _maybe_listed(F.col("h"), bitmap_words(shingles, "h", BITMAP_BITS)))
    n = F.greatest(F.size("w"), F.lit(1))
    place = F.when(F.col("at") > 0, (F.col("at") - 1) % n).otherwise(-1)
    from_ = F.greatest(place - (WINDOW - 1), F.lit(0))
    around = F.when(F.col("at") > 0, F.slice("w", from_ + 1, F.lit(2 * WINDOW - 1)))
    return rows.select(
        "doc_id", "text_hash", "n_words", "h", place.alias("place"), from_.alias("around_from"), around.alias("around")
    )


def occurrences(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (``doc_id, text_hash, n_words``) and the exact occurrences of windows in them.

    Occurrences are rows (``doc_id, text_hash, begin, size, item``), a row for each item of the window.
    """
    listed = benchmark_windows(benchmark).withColumn("window_id", F.xxhash64("window"))
    windows = stage(listed, "windows")
    distinct = windows.select("window_id", "window").distinct()
    width = F.least(F.lit(SHINGLE), F.size("window"))
    widths = sorted(r[0] for r in distinct.select(width.alias("k")).distinct().toLocalIterator())
    window = F.col("window")
    def parts_of(k: int) -> Column:
        firsts = F.slice(window, F.lit(1), F.size(window) - (k - 1))
        return F.when(width == k, F.transform(firsts, lambda x, i: _shingle(window, x, i, k)))

    by_width = F.coalesce(*[parts_of(k) for k in widths], F.array().cast("array<bigint>"))
    parts = distinct.select("window_id", "window", F.posexplode(by_width).alias("offset", "h"))
    shingles = parts.select("h").distinct()
    found = stage(_candidates(documents, shingles, widths), "places")
    docs = found.where("place < 0").select("doc_id", "text_hash", "n_words")
    places = found.where("place >= 0")
    counts = places.join(shingles, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    # A shingle without a count is in no document, and neither is its window.
    rare = parts.join(counts, "h", "left").groupBy("window_id", "window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("p")
    )
    prefix = rare.where("p.n > 0").select("window_id", "window", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    joined = places.join(prefix, "h").withColumn("begin", F.col("place") - F.col("offset"))
    joined = joined.where((F.col("begin") >= 0) & (F.col("begin") + F.size("window") <= F.col("n_words")))
    same = F.slice("around", F.col("begin") - F.col("around_from") + 1, F.size("window")) == F.col("window")
    exact = joined.where(same).select(
        "doc_id", "text_hash", "window_id", F.col("window").alias("__w"), "begin", F.size("window").alias("size")
    ).distinct()
    exact = exact.withColumnRenamed("window_id", "__id")
    items = windows.select("window_id", "window", "item")
    hit = exact.join(items, (F.col("__id") == F.col("window_id")) & (F.col("__w") == F.col("window")))
    return docs, hit.select("doc_id", "text_hash", "begin", "size", "item")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``documents``: its words, those inside occurrences, the items that occur, and the verdict."""
    docs, hits = occurrences(documents, benchmark)
    spans = F.array_sort(F.collect_set(F.struct("begin", "size")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["begin"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(s["begin"] + s["size"] - F.greatest(a["end"], s["begin"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per = hits.groupBy("doc_id", "text_hash").agg(
        spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    per = per.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), covered.alias("n"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    n_hit = F.coalesce("n", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(per, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (MIN_HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    bad = contamination(documents, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return documents.join(bad, same, "left_anti")


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH iw AS (SELECT item_id, {_W} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT list(DISTINCT k) AS ks FROM win),
dw AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g, len(w) AS n
          FROM (SELECT doc_id, w, i, unnest((SELECT ks FROM sizes)) AS k FROM pos) WHERE i + k - 1 <= len(w)),
occ AS (SELECT doc_id, i, grams.k AS k, item_id FROM grams JOIN win USING (g, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op2_decontaminate", SQL)
def op2_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
