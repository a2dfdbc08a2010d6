"""Source divergence audit: which sources of a language differ, and by which terms, in exact integers.

Terms are runs of letters (and of anything beyond ASCII), A-Z lower-cased. A language keeps the terms
that enough of its documents have. A group (language, source) gives each kept term the smoothed share
``p = 1 + floor(unit * (count + 1) / (all counts + kept terms))``, and ``f(p, q) = floor((p - q)^2 / q)``
says how far it lies from a share q.

Terms of a group are ranked by count cells: ``f`` depends on a term's count in the group and in the
language alone, so it is worked out once for each such cell, equal values are merged, values are ranked
by how many terms lie before them, and only cells that reach the limit are expanded into terms, in
UTF-8 order. Two sources are compared by the sum of ``f`` over all kept terms: terms that neither has
add one product, terms that one has are added by the cells of its counts, and only for terms that both
have is the difference to that worked out, in arrays over the sources of each term.

Defined results: null text, language and source are read as empty, which is a language or source like
any other; repeated rows count as often as they stand; a group without terms has count 0 everywhere; a
language without kept terms has pair values 0 and no term rows; equal values are ranked by the item's
bytes; an empty table gives no rows. A very long text is read in pieces cut between terms and never
held as terms at once. Other columns are not read, so their names may clash. The row of a term holds at
most one entry for each source of its language, as many as the result has rows for each group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import small_batches, table
from tally.llm.registry import query
from tally.session import stage

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TERM_RANKS = 200
# Bytes of a text that are cut into terms at once, and terms a task counts before it hands the counts on.
PIECE = 1 << 20
COUNTED = 200_000
# Pairs of entries worked out at once, sources in a block of sums, and blocks held at once.
PAIRS = 1 << 20
BLOCK = 1 << 10
BLOCKS = 16
# Letters to lower case, all other ASCII to blanks; bytes of longer characters stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text = text.translate(FOLDED)
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield text[start:].split() if start else text.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents by language and source; the null term counts the documents themselves."""
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    times: dict[tuple, Counter] = {}
    having: dict[tuple, Counter] = {}
    rows: Counter = Counter()

    def handed() -> pa.RecordBatch:
        flat = [(*group, term, n, having[group].get(term, 0)) for group, counts in times.items() for term, n in counts.items()]
        # A document's terms are counted as had when it ends, which can be after its counts were handed on.
        flat += [
            (*group, term, 0, n) for group, counts in having.items() for term, n in counts.items()
            if term not in times.get(group, ())
        ]
        flat += [(*group, None, 0, n) for group, n in rows.items()]
        for held in (times, having, rows):
            held.clear()
        columns = zip(*flat) if flat else [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    for batch in small_batches(batches):
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            group = (lang, source)
            rows[group] += 1
            seen: set[bytes] = set()
            for terms in _pieces(text.as_py()):
                times.setdefault(group, Counter()).update(terms)
                seen.update(terms)
            having.setdefault(group, Counter()).update(seen)
            if sum(map(len, times.values())) > COUNTED:
                yield handed()
    yield handed()


def term_counts(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; the null term stands for the group and its documents."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    partial = documents.select(*columns).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)`` of terms that ``least`` documents of the language have; one row is first of its term."""
    whole = Window.partitionBy("lang", "term")
    order = whole.orderBy("source")
    kept = counts.where("term IS NOT NULL").select(
        "lang", "source", "term", "n", F.sum("docs").over(whole).alias("lang_docs"), F.sum("n").over(whole).alias("lang_n"),
        (F.row_number().over(order) == 1).cast("long").alias("first"),
    )
    return kept.where(F.col("lang_docs") >= least).drop("lang_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + terms))``, exact at any count; of no use where nothing is kept."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most UNIT + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that both sources have, of ``f`` less what the two counted alone would add.

    A row is a term with the entries (source, share, share of a term it lacks) of its sources.
    """
    sums: dict[tuple, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        found = [[], [], [], []]
        for (lang, a, b), block in sums.items():
            s, t = np.nonzero(block)
            for column, values in zip(found, ([lang] * len(s), s + a * BLOCK, t + b * BLOCK, block[s, t])):
                column.extend(values)
        sums.clear()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names=["lang", "s", "t", "value"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        entries = batch.column("entries")
        first = entries.offsets.to_numpy()
        flat = entries.values
        sid, p, p0 = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        size = np.diff(first)
        # Entry e meets all entries of its term: places first[term] and so on, size[term] of them.
        begin, meets = np.repeat(first[:-1], size), np.repeat(size, size)
        lang_of = np.repeat(langs, size)
        upto = np.concatenate(([0], np.cumsum(meets)))
        e = int(first[0])
        k = 0
        while k < len(meets):
            end = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(k, end) + e, meets[k:end])
            j = np.arange(len(i)) - np.repeat(upto[k:end] - upto[k], meets[k:end]) + np.repeat(begin[k:end], meets[k:end])
            other = i != j
            i, j = i[other], j[other]
            value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
            here = lang_of[i - e]
            for lang in set(here.tolist()):
                mine = here == lang
                s, t, v = sid[i[mine]], sid[j[mine]], value[mine]
                for a, b in set(zip((s // BLOCK).tolist(), (t // BLOCK).tolist())):
                    at = (s // BLOCK == a) & (t // BLOCK == b)
                    if (lang, a, b) not in sums:
                        if len(sums) >= BLOCKS:
                            yield handed()
                        sums[lang, a, b] = np.zeros((BLOCK, BLOCK), np.int64)
                    np.add.at(sums[lang, a, b], (s[at] % BLOCK, t[at] % BLOCK), v[at])
            k = end
    yield handed()


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, sid, total, terms, lang_total)`` of every group, with kept terms or without; sources numbered in their language."""
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("sid")
    groups = counts.where("term IS NULL").select("lang", "source", number)
    sized = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    return sized.na.fill(0, ["total", "terms", "lang_total"])


def term_ranks(kept: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms of each group that lie furthest above the language."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms_here"))
    cells = cells.join(sizes, ["lang", "source"]).select(
        "lang", "source", "n", "lang_n", "terms_here",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    cells = stage(cells.where("p > q").withColumn("value", distance(F.col("p"), F.col("q"))), "cells")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms_here").alias("terms_here"))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value has a term at least, so the first ``most`` values are enough; of them those with fewer terms before.
    values = values.withColumn("r", F.row_number().over(group)).where(F.col("r") <= most)
    upto = F.sum("terms_here").over(group.rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("before", upto - F.col("terms_here")).where(F.col("before") < most)
    chosen = cells.join(values.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi")
    found = kept.join(chosen.select("lang", "source", "n", "lang_n", "value"), ["lang", "source", "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term")))
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", place.alias("rank"))
    return found.where(F.col("rank") <= most)


def pair_ranks(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every other source of the language, ranked by the sum of ``f`` over all kept terms."""
    none = share(F.lit(0), F.col("total"), F.col("terms"))
    sized = sizes.where("terms > 0").select("lang", "source", "sid", "total", "terms", none.alias("p0"))
    own = kept.join(sized, ["lang", "source"]).select(
        "lang", "term", "sid", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    )
    entries = own.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("entries"))
    both = entries.where(F.size("entries") > 1).select("lang", "entries").mapInArrow(_both, "lang string, s int, t int, value long")
    # What the terms of one source add against terms that the other lacks, over what terms that both lack would add.
    cells = own.groupBy("lang", "sid", "p", "p0").agg(F.count("*").alias("m"))
    other = sized.select("lang", F.col("sid").alias("sid_b"), F.col("p0").alias("p0_b"))
    met = cells.join(other, "lang").where("sid <> sid_b")
    p, a, b, m = (F.col(c) for c in ("p", "p0", "p0_b", "m"))
    alone = met.select("lang", F.inline(F.array(
        F.struct(F.col("sid").alias("s"), F.col("sid_b").alias("t"), (m * (distance(p, b) - distance(a, b))).alias("value")),
        F.struct(F.col("sid_b").alias("s"), F.col("sid").alias("t"), (m * (distance(b, p) - distance(b, a))).alias("value")),
    )))
    sums = both.unionByName(alone).groupBy("lang", "s", "t").agg(F.sum("value").alias("more"))
    names = sizes.select("lang", F.col("source").alias("item"), F.col("sid").alias("t"), none.alias("q0"))
    pairs = sizes.select("lang", "source", F.col("sid").alias("s"), "terms", none.alias("p0")).join(names, "lang").where("s <> t")
    value = F.when(
        F.col("terms") > 0, F.col("terms") * distance(F.col("p0"), F.col("q0")) + F.coalesce("more", F.lit(0))
    ).otherwise(0)
    pairs = pairs.join(sums, ["lang", "s", "t"], "left").select("lang", "source", "item", value.alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, most: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources (part ``pair``) and terms (part ``term``) of every group."""
    counts = stage(term_counts(documents), "counts")
    kept = stage(kept_terms(counts, least), "kept")
    sizes = stage(group_sizes(counts, kept), "sizes")
    return pair_ranks(kept, sizes).unionByName(term_ranks(kept, sizes, most))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN (SELECT lang, term FROM v) USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS k, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS total
      FROM (SELECT DISTINCT lang, source FROM d) AS x),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS lang_n, l.total AS lang_total, l.k,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.k) AS p
      FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p AS x JOIN p AS y USING (lang, term)
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
q AS (SELECT lang, source, term, p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + k) AS q FROM p WHERE n > 0),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM q WHERE p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", SQL)
def op13_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
