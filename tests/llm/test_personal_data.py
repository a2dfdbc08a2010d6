"""Base spans against plain Python, added spans on planted forms, and how the votes are weighed."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tally.llm import personal_data
from tally.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text):
    return re.sub("[^0-9]", "", text)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only_digits(m)) <= 15),
)


def plain(text):
    """Counts by kind and the digest of the base spans."""
    spans = []
    for order, (kind, pattern, holds) in enumerate(PLAIN):
        spans += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if holds(m.group())]
    counts = tuple(sum(s[1] == k for s in spans) for k in range(4))
    return counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


ODD = [
    "a@b.c_d@e.f a@b.c@d.e x@y x@y. @y.z a..b@c-d.e.f.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.001.1.0 1.2.3 9.9.9.9999 1.2.3.4a",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-9 4111  1111 5500005555555559x 0 00",
    "+1 (743) 555-3824 +12 +123456789 ++49 30 1234567890123456 +49 (0)30.123-45 67 ) + 1 222 333 4444",
    "é😀a@b.de ü 10.0.0.1 中 +44 20 7946 0958 文",
    "1" * 3_000 + "." + "x" * 3_000 + "@" + "a." * 10_000 + "b",
    "a@b.cd " * 3_000,
]


def checked(rows, texts):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(texts)
    for i, text in texts.items():
        counts, digest = plain(text)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts, text and text[:80]
        assert r.base_sha256 == digest
        base = {s for s in r.spans.split(",") if s}
        assert len(base) == sum(counts) + r.n_added


def test_base_spans_of_odd_texts(spark):
    texts = dict(enumerate([None, "", " \n", *ODD, ODD[0]]))
    df = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("spans", F.lit(1)).withColumn("id", F.lit("clash"))
    checked(personal_data.personal_spans(df).collect(), texts)
    assert personal_data.personal_spans(df.limit(0)).count() == 0


def test_base_spans_of_documents(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    checked(QUERIES["op12_personal_data"](spark, SF).collect(), texts)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(personal_data.running(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(n)]


def test_looser_forms_are_added_and_failing_matches_are_not(spark):
    rows = []
    for i in range(40):
        rows += [
            (5 * i, f"please write to the mail bob{i}@host{i}.com for more"),
            (5 * i + 1, f"contact ann{i} [at] mail{i} [dot] org today"),
            (5 * i + 2, f"phone +1 (415) 555-{1000 + i} or call (212) 555-{2000 + i} today"),
            (5 * i + 3, f"the order 4111 1111 1111 1{i:03d} of version 999.1.2.{i} is late"),
            (5 * i + 4, "nothing in here at all"),
        ]
    got = {r.doc_id: r for r in personal_data.personal_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(40):
        assert got[5 * i].spans == f"email:25:{25 + len(f'bob{i}@host{i}.com')}"
        assert got[5 * i + 1].spans.startswith("email:8:") and got[5 * i + 1].n_added == 1
        assert got[5 * i + 2].spans == "phone:6:23,phone:32:46"
        assert got[5 * i + 3].n_added == 0
        assert got[5 * i + 4].spans == ""


def test_votes_against_a_plain_fit(spark):
    """One round of expectation and maximisation by hand."""
    rows = [(0, [1, 1, 1, 0, 1], 90), (0, [2, 2, 0, 0, 1], 30), (0, [1, 1, 0, 1, 1], 20), (2, [2, 2, 2, 0, 2], 5)]
    weights, priors = personal_data.vote_weights(spark.createDataFrame(rows, "kind int, votes array<int>, n long"), 1)
    import math

    ratio = {0: 0.0, 1: math.log(4), 2: -math.log(4)}
    post = [1 / (1 + math.exp(-sum(ratio[v] for v in votes))) for _, votes, _ in rows[:3]]
    yes = sum(p * n for p, (_, _, n) in zip(post, rows))
    no = sum((1 - p) * n for p, (_, _, n) in zip(post, rows))
    assert priors[0] == pytest.approx(math.log((yes + 20) / (no + 20)))
    said = [p * n for p, (_, v, n) in zip(post, rows) if v[0] == 1], [(1 - p) * n for p, (_, v, n) in zip(post, rows) if v[0] == 1]
    expected = math.log((sum(said[0]) + 20 * 0.72) / (yes + 20)) - math.log((sum(said[1]) + 20 * 0.18) / (no + 20))
    assert weights[1] == pytest.approx(expected)
    assert priors[1] == 0 and weights[(1 * 5) * 3 + 1] == pytest.approx(math.log(4))
