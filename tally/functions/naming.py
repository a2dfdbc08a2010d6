"""Column names: how they read and how alike they are."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally import fixed


def humanise(name: str) -> str:
    """Display label of a column name: ``avg_numeracy`` reads "Average Numeracy"."""
    words = [fixed.LABEL_WORDS.get(w) or w.capitalize() if w[0].islower() else w for w in name.split("_") if w]
    return " ".join(words)


def humanise_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its display label."""
    return df.withColumnsRenamed({c: humanise(c) for c in df.columns})


def _name_tokens(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(c), r"[_\s]+"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over combined size of two token arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(c: Column) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(1)))
    return F.slice(every, F.lit(1), F.length(c))


def _longest_block(x: Column, y: Column, r: Column) -> Column:
    """The longest block that two arrays share inside a range: its length and where it starts; the earliest in ``x``, then in ``y``.

    Row by row over ``x``: how long the block is that ends at each place of ``y``.
    """
    xs = F.slice(x, r["xl"] + 1, r["xh"] - r["xl"])
    ys = F.slice(y, r["yl"] + 1, r["yh"] - r["yl"])

    def row(s: Column, ch: Column) -> Column:
        ends = F.transform(ys, lambda c, p: F.when(c == ch, F.when(p > 0, F.get(s["ends"], p - 1)).otherwise(0) + 1).otherwise(0))

        def peaked(e: Column) -> Column:
            peak = F.array_max(e)
            better = peak > s["k"]
            at = F.array_position(e, peak).cast("int")
            return F.struct(
                e.alias("ends"), F.when(better, peak).otherwise(s["k"]).alias("k"),
                F.when(better, s["at"] + 1 - peak).otherwise(s["i"]).alias("i"), F.when(better, at - peak).otherwise(s["j"]).alias("j"),
                (s["at"] + 1).alias("at"),
            )

        return _let(ends, peaked)

    zero = F.lit(0)
    start = F.struct(F.transform(ys, lambda c: zero).alias("ends"), zero.alias("k"), zero.alias("i"), zero.alias("j"), zero.alias("at"))
    return F.aggregate(
        xs, start, row, lambda s: F.struct(s["k"].alias("k"), (r["xl"] + s["i"]).alias("i"), (r["yl"] + s["j"]).alias("j"))
    )


def matching_share(a: Column, b: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 1 where both are empty.

    The longest common block is taken, then the longest to its left and to its right, and so on; the
    ranges still to be searched wait in an array.
    """

    def matched(t: Column) -> Column:
        x, y = t["x"], t["y"]

        def span(xl: Column, xh: Column, yl: Column, yh: Column) -> Column:
            return F.struct(xl.alias("xl"), xh.alias("xh"), yl.alias("yl"), yh.alias("yh"))

        def step(s: Column, _: Column) -> Column:
            r = F.element_at(s["open"], -1)

            def split(m: Column) -> Column:
                sides = F.array(
                    span(r["xl"], m["i"], r["yl"], m["j"]), span(m["i"] + m["k"], r["xh"], m["j"] + m["k"], r["yh"])
                )
                sides = F.filter(sides, lambda v: (m["k"] > 0) & (v["xl"] < v["xh"]) & (v["yl"] < v["yh"]))
                rest = F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)
                return F.struct(F.concat(rest, sides).alias("open"), (s["n"] + m["k"]).alias("n"))

            return F.when(F.size(s["open"]) == 0, s).otherwise(_let(_longest_block(x, y, r), split))

        whole = F.filter(F.array(span(F.lit(0), F.size(x), F.lit(0), F.size(y))), lambda v: (v["xh"] > 0) & (v["yh"] > 0))
        # Each range is either without a match or holds a block of its own, so there are at most two for each letter.
        turns = F.sequence(F.lit(1), 2 * F.least(F.size(x), F.size(y)) + 1)
        n = F.aggregate(turns, F.struct(whole.alias("open"), F.lit(0).alias("n")), step, lambda s: s["n"])
        both = F.size(x) + F.size(y)
        return F.when(both > 0, 2.0 * n / both).otherwise(F.lit(1.0))

    return _let(F.struct(_chars(a).alias("x"), _chars(b).alias("y")), matched)


def similarity(a: Column, b: Column) -> Column:
    """Half matching blocks, half shared words, three decimals; for names in rows."""
    return F.round(0.5 * matching_share(F.lower(a), F.lower(b)) + 0.5 * jaccard(_name_tokens(a), _name_tokens(b)), 3)


def name_similarity(a: str, b: str) -> float:
    """The same measure for headers, which are known before a job runs."""
    a, b = a.lower(), b.lower()
    x, y = (set(re.split(r"[_\s]+", name)) for name in (a, b))
    return round(0.5 * SequenceMatcher(None, a, b).ratio() + 0.5 * len(x & y) / len(x | y), 3)


def fingerprint(c: Column) -> Column:
    """Shape of a value: digits become 9, then letters become A."""
    return F.regexp_replace(F.regexp_replace(c, r"\d", "9"), "[A-Za-z]", "A")
