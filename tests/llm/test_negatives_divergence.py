"""Hard negatives against plain integers, the divergence audit against its SQL, both on odd rows."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tally.llm import hard_negatives, source_divergence
from tools.check import compare


def plain_negatives(rows):
    """Anchors are ids divisible by 5; two positives, two negatives."""
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        known[i, label, q] = None
    known = sorted(known)

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    out = []
    for a in known:
        if a[0] % 5:
            continue
        others = sorted(((-score(a, b), b) for b in known if b is not a), key=lambda x: (x[0], x[1][0]))
        for p, b in [x for x in others if x[1][1] == a[1]][:2]:
            found = [(s, c) for s, c in others if c[1] != a[1] and 80 * -p <= 100 * -s <= 100 * -p][:2]
            out += [(a[0], b[0], r, c[0], -p, -s) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


def test_negatives_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.uniform(-0.2, 1) for _ in range(rng.choice([9, 16, 17]))]) for i in range(120)]
    rows += [(i, i % 2, [0.5] * 16) for i in range(120, 160)]  # ties
    rows += rows[:20]  # repeated rows
    rows += [(200, None, [1.0]), (205, 1, None), (210, 1, [float("nan")] * 16), (215, 1, [None, 1.0]), (220, 1, [float("inf")])]
    rows += [(225, 1, []), (230, 7, [1.0] * 16), (None, 1, [1.0] * 16), (235, -3, [1e6, -1e6, 3.0]), (241, 0, [9e5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    df = df.withColumns({c: F.lit("clash") for c in ("id", "key", "anchor", "planes", "rb", "score")})
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, positives=2, negatives=2)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_planes_and_tables():
    rng = np.random.default_rng(1)
    for top in (1, 127, 128, 1 << 40):
        x = rng.integers(-top, top + 1, (50, 24))
        packed = [hard_negatives.pack(row) for row in x]
        table = pa.table({
            "id": np.arange(50), "key": np.arange(50), "label": np.zeros(50, np.int64),
            "width": pa.array([3] * 50, pa.int32()), "planes": pa.array(packed, pa.binary()),
        })
        rows = hard_negatives._Rows(table)
        assert (rows.integers() == x).all()
        sums = hard_negatives.subset_sums(x[:7])
        assert (hard_negatives.scores(sums, rows, np.arange(50)) == x[:7] @ x.T).all()


def test_divergence_of_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{chr(97 + i)}{c}" for i in range(20) for c in ("x", "é", "\U0001f600", "ß")]
    rows = [
        (i, " ".join(rng.choices(words, weights=range(1, 81), k=rng.randrange(0, 60))), rng.choice(["en", "de", None, ""]),
         rng.choice(["a", "b", "É", None, ""]))
        for i in range(200)
    ]
    rows += [(300, None, "fr", "a"), (301, "", "fr", "b"), (302, "one", "fr", None), (303, "Only HERE 1 2 3", "it", "x")]
    rows += [(5, "same same\x00same", "en", "a")] * 4 + [(None, "word " * 5000, "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "total", "sid", "value")})
    con = duckdb.connect()
    documents = pa.table(dict(zip(["doc_id", "text", "lang", "source"], map(list, zip(*rows)))))
    con.register("documents", documents)
    assert compare(source_divergence.divergence(df), con, source_divergence.SQL) == ""
    assert source_divergence.divergence(df.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = ("Some words, ÉÉ and\nmore " * 400).encode() + b"x" * 999
    whole = [t for terms in source_divergence._pieces(text) for t in terms]
    monkeypatch.setattr(source_divergence, "PIECE", 64)
    pieces = list(source_divergence._pieces(text))
    assert len(pieces) > 50 and [t for terms in pieces for t in terms] == whole


def test_counts_handed_on_in_the_middle(monkeypatch):
    batch = pa.table({"text": ["a b c", "b c d", "", "a"], "lang": ["x", "x", "y", "x"], "source": ["s", "s", "s", "t"]})
    monkeypatch.setattr(source_divergence, "COUNTED", 2)
    total = {}
    for out in source_divergence._counted(iter(batch.to_batches())):
        for r in out.to_pylist():
            k = (r["lang"], r["source"], r["term"])
            n, docs = total.get(k, (0, 0))
            total[k] = (n + r["n"], docs + r["docs"])
    assert total["x", "s", "b"] == (2, 2) and total["x", "s", None] == (0, 2) and total["y", "s", None] == (0, 1)
    assert total["x", "t", "a"] == (1, 1) and len(total) == 8
