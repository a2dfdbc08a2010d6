"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Four base patterns (email, ip, card, phone) are found left to right and kept where their check holds.
They and looser forms (obscured addresses, 128-bit addresses, numbers without a country code, short
cards, matches that fail the check) are the candidates. On each, five labelers say yes, no or nothing:
the pattern with its check, a plausibility rule, a gazetteer (domains, issuers, nets, country codes),
cue words before the span, and the characters around it. Expectation-maximisation over the counts of
vote patterns estimates per kind how often each labeler says what of true and of false spans, and so
a probability for each span; with these as soft labels a naive Bayes classifier over shape, length,
word before, first characters and plausibility is counted. What it accepts joins the base spans.

All of it is DataFrame expressions: one pass over the texts stages the candidates without text, the
rounds run over at most ``4 * 3**5`` vote patterns, and ``4 * 5 * 256`` weights return as a literal.

Defined results: null texts are read as empty, empty ones have no spans; repeated rows are judged
alike; positions are in code points, ends exclusive; spans that start together are ordered email, ip,
card, phone; a looser span that meets a base span is dropped; a table without candidates, or an empty
one, is judged by the starting beliefs. Texts of any length are searched whole, and positions are
summed in blocks so that many matches in one text cost no square. Only id and text are read, so other
names may clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import table
from tally.llm.registry import query
from tally.session import stage

KINDS = ("email", "ip", "card", "phone")
# Base patterns. A look behind and possessive counts change no match and keep long runs linear.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Looser forms. The last shares the pass of the base phone: it has no plus, so neither can cut into the other.
OBSCURED = rf"(?<!{LOCAL}){LOCAL}++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++"
LONG_IP = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"
LOCAL_PHONE = r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
PARTS = rf"^(?:{PART}\.){{3}}{PART}$"
# Gazetteers: top domains, issuers' first digits, nets that name no one, country codes.
DOMAINS = r"(?i)[.\])] ?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|us|eu|at|ch|it)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65)"
NO_ONES = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^(?:0+:){7}"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words before a span that speak for it, by kind, and such that speak against any.
CUES = (
    r"(?i)(?:mail|contact|kontakt|write to|correo|courriel|adress?e?|@)\W*$",
    r"(?i)\b(?:ip|host|server|address|adresse|from|login)\W*$",
    r"(?i)(?:card|visa|mastercard|amex|karte|tarjeta|carte)\W*(?:\w+\W+)?$",
    r"(?i)(?:call|phone|tel|mobile|fax|telefon|rufen|llamar|appeler)\w*\W*(?:\w+\W+)?$",
)
AGAINST = r"(?i)\b(?:version|order|isbn|invoice|ref|id|section|chapter|part|token|serial)\W*$"
CONTEXT = 32
YES, NO = 1, 2
LABELERS = 5
SLOTS, BUCKETS = 5, 256
ROUNDS = 8
# How far the starting beliefs count: a labeler that speaks is right this often, as if seen on so many spans.
TRUST, SEEN = 0.8, 20.0
PREFIX = 256


def running(lengths: Column) -> Column:
    """The sum of what stands before each place; block by block, so that long arrays are not copied per place."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PREFIX).cast("int"))

    def block(b: Column) -> Column:
        return F.slice(lengths, b * PREFIX + 1, F.lit(PREFIX))

    def sums(values: Column, first: Column) -> Column:
        none = F.struct(first.alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            values, none, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")), lambda s: s["a"]
        )

    zero = F.lit(0).cast("bigint")
    starts = sums(F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda t, x: t + x)), zero)
    each = F.flatten(F.zip_with(blocks, starts, lambda b, t: sums(block(b), t)))
    return F.when(F.size(lengths) > 0, each).otherwise(F.array().cast("array<bigint>"))


def _digits(match: Column) -> Column:
    return F.translate(match, " -.()+", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    one = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int"))
    doubled = F.transform(one, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda t, x: t + x) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(0)


def _judged(kind: int, strict: Column, m: Column, before: Column, after: Column) -> tuple[Column, list[Column]]:
    """Whether a match is a base span, and the five votes on it."""
    n = F.length(_digits(m))
    if kind == 0:
        holds, likely = strict, ~m.rlike(r"^\.|\.\.|\.@") & (F.length(m) <= 254)
        listed = _vote(m.rlike(DOMAINS), F.lit(False))
    elif kind == 1:
        holds = strict & m.rlike(PARTS)
        likely = holds | ~strict
        listed = _vote(F.lit(False), m.rlike(NO_ONES))
    elif kind == 2:
        right = luhn(_digits(m))
        holds, likely = strict & right, right
        listed = _vote(m.rlike(ISSUERS), ~m.rlike(ISSUERS))
    else:
        holds = strict & n.between(10, 15)
        likely = n.between(10, 15)
        listed = _vote(m.rlike(COUNTRIES), F.lit(False))
    glued = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
    votes = [
        _vote(holds, strict & ~holds), _vote(likely, ~likely), listed,
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), _vote(~glued, glued),
    ]
    return holds, votes


def _span(kind: int, loose: str | None):
    """A candidate from its match, what stands before and after it, and where it starts."""

    def span(x: Column) -> Column:
        m, before, after = x["m"], x["b"], x["c"]
        strict = F.lit(loose is None)
        if kind == 2:
            strict = F.length(_digits(m)).between(14, 19)
        elif kind == 3:
            strict = m.startswith("+")
        holds, votes = _judged(kind, strict, m, before, after)
        shape = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a")
        word = F.lower(F.regexp_extract(before, r"([^\s]*)\s*$", 1))
        features = [
            shape, F.least(F.length(m), F.lit(63)).cast("string"), word, F.substr(m, F.lit(1), F.lit(2)),
            F.concat(votes[1].cast("string"), votes[4].cast("string")),
        ]
        return F.struct(
            x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(m)).alias("end"), holds.alias("base"),
            F.array(*votes).alias("votes"),
            F.array(*[F.pmod(F.xxhash64(f), F.lit(BUCKETS)).cast("int") for f in features]).alias("features"),
        )

    return span


def _passes(text: Column) -> list[tuple[int, str | None, str, Column]]:
    """Kind, looser form or none, pattern, and the cheap test without which it cannot match."""
    digit = text.rlike("[0-9]")
    return [
        (0, None, BASE[0], text.contains("@")),
        (0, "obscured", OBSCURED, text.contains("at]") | text.contains("at)")),
        (1, None, BASE[1], digit & text.contains(".")),
        (1, "long", LONG_IP, F.length(text) - F.length(F.translate(text, ":", "")) >= 7),
        (2, None, BASE[2], digit),
        (3, None, f"{BASE[3]}|{LOCAL_PHONE}", digit),
    ]


def _surrounded(gaps: Column):
    """A match with its place and what stands before and after it."""

    def row(x: Column, k: Column) -> Column:
        before, after = F.get(gaps, k), F.get(gaps, k + 1)
        return F.struct(
            x["m"].alias("m"), (x["s"] + F.length(before)).alias("at"),
            F.substr(before, F.lit(-CONTEXT), F.lit(CONTEXT)).alias("b"), F.substr(after, F.lit(1), F.lit(4)).alias("c"),
        )

    return row


def candidates(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, spans)``, one row for each row: all candidate spans with votes and hashed features, without text."""
    text = F.col("__text")
    df = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    passes = _passes(text)
    none = F.array().cast("array<string>")
    df = df.select("id", "__text", *[
        F.when(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m{i}")
        for i, (_, _, p, gate) in enumerate(passes)
    ])
    # What lies between the matches of a pass, which gives their places and what stands around them.
    df = df.select("id", *[f"m{i}" for i in range(len(passes))], *[
        F.when(F.size(f"m{i}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"g{i}") for i, (_, _, p, _) in enumerate(passes)
    ])
    lengths = [
        F.zip_with(F.slice(f"g{i}", F.lit(1), F.size(f"m{i}")), f"m{i}", lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        for i in range(len(passes))
    ]
    df = df.select("*", *[x.alias(f"l{i}") for i, x in enumerate(lengths)])
    df = df.select("*", *[running(F.col(f"l{i}")).alias(f"s{i}") for i in range(len(passes))])
    found = []
    for i, (kind, loose, _, _) in enumerate(passes):
        gaps = F.col(f"g{i}")
        rows = F.zip_with(f"m{i}", f"s{i}", lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        rows = F.transform(rows, _surrounded(gaps))
        if kind == 2:
            rows = F.filter(rows, lambda x: F.length(_digits(x["m"])).between(13, 19))
        found.append(F.transform(rows, _span(kind, loose)))
    return df.select("id", F.array_sort(F.concat(*found)).alias("spans"))


def _literal(values: list[float]) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def vote_logit(weights: list[float], priors: list[float], kind: Column, votes: Column) -> Column:
    """Log odds of a span by its votes; ``weights`` by kind, labeler and vote, ``priors`` by kind."""
    table_ = _literal(weights)
    total = F.get(_literal(priors), kind)
    for k in range(LABELERS):
        total = total + F.get(table_, (kind * LABELERS + k) * 3 + F.get(votes, F.lit(k)))
    return total


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def vote_weights(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over counts ``n`` of (``kind``, ``votes``): log ratios of what labelers say of true and false spans."""
    believed = {1: (0.1, TRUST * 0.9, (1 - TRUST) * 0.9), 0: (0.1, (1 - TRUST) * 0.9, TRUST * 0.9)}
    start = [math.log(believed[1][v] / believed[0][v]) for v in range(3)]
    weights, priors = start * (len(KINDS) * LABELERS), [0.0] * len(KINDS)
    for _ in range(rounds):
        post = probability(vote_logit(weights, priors, F.col("kind"), F.col("votes")))
        by_class = {1: F.col("n") * post, 0: F.col("n") * (1 - post)}
        said = patterns.groupBy("kind").agg(*[
            F.sum(F.when(F.get("votes", F.lit(k)) == v, x).otherwise(0.0)).alias(f"s{y}_{k}_{v}")
            for y, x in by_class.items() for k in range(LABELERS) for v in range(3)
        ])
        for row in said.collect():
            kind = row["kind"]
            total = {y: sum(row[f"s{y}_0_{v}"] for v in range(3)) for y in (0, 1)}
            priors[kind] = math.log((total[1] + SEEN) / (total[0] + SEEN))
            for k in range(LABELERS):
                for v in range(3):
                    share = {y: (row[f"s{y}_{k}_{v}"] + SEEN * believed[y][v]) / (total[y] + SEEN) for y in (0, 1)}
                    weights[(kind * LABELERS + k) * 3 + v] = math.log(share[1] / share[0])
    return weights, priors


def feature_weights(spans: DataFrame, post: Column) -> tuple[list[float], list[float]]:
    """Naive Bayes over the hashed features of all candidates, counted with soft labels."""
    slots = F.posexplode(F.concat(F.col("features"), F.array(F.lit(-1)))).alias("slot", "bucket")
    counted = spans.select("kind", post.alias("y"), slots).groupBy("kind", "slot", "bucket")
    rows = counted.agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).collect()
    # The bucket -1 after the features stands for the span itself.
    total = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["bucket"] == -1}
    weights, priors = [0.0] * (len(KINDS) * SLOTS * BUCKETS), [0.0] * len(KINDS)
    for kind, (yes, no) in total.items():
        priors[kind] = math.log((yes + 1) / (no + 1))
        unseen = math.log((no + BUCKETS) / (yes + BUCKETS))
        first = kind * SLOTS * BUCKETS
        weights[first : first + SLOTS * BUCKETS] = [unseen] * (SLOTS * BUCKETS)
    for r in rows:
        if r["bucket"] >= 0:
            yes, no = total[r["kind"]]
            place = (r["kind"] * SLOTS + r["slot"]) * BUCKETS + r["bucket"]
            weights[place] = math.log((r["yes"] + 1) / (yes + BUCKETS)) - math.log((r["no"] + 1) / (no + BUCKETS))
    return weights, priors


def _named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def personal_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans by kind, their digest, all spans as text, and how many the method adds."""
    found = stage(candidates(documents, id_col, text_col), "candidates")
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = stage(spans.groupBy("kind", "votes").agg(F.count("*").alias("n")), "votes")
    votes = vote_weights(patterns)
    weights, priors = feature_weights(spans, probability(vote_logit(*votes, F.col("kind"), F.col("votes"))))
    learned, prior = _literal(weights), _literal(priors)

    def accepted(s: Column) -> Column:
        total = F.get(prior, s["kind"])
        for k in range(SLOTS):
            total = total + F.get(learned, (s["kind"] * SLOTS + k) * BUCKETS + F.get(s["features"], F.lit(k)))
        return total > 0

    df = found.select("id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    loose = F.filter("spans", lambda s: ~s["base"] & accepted(s))
    df = df.withColumn("loose", loose)
    added = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.withColumn("added", F.when(F.size("loose") > 0, added).otherwise(F.col("loose")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select(
        F.col("id").alias(id_col), *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


@query("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    return personal_spans(table(spark, sf_dir, "documents"))
