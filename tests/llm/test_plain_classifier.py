"""The quality classifier against plain counts, plain ratios and a plain Gumbel draw."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tally.llm import quality_classifier as qc
from tally.llm.common import table
from tally.llm.wordarrays import shape_hashes, word_arrays

SF = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    return x ^ (x >> 27)


def joined(x, y):
    return mixed((x * 0x9E3779B97F4A7C15 + y) & ALL)


def plain_grams(text, seen):
    """Buckets of words, word pairs and triples of shapes, one after the other."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for w in words:
        if w not in seen:
            one = word_arrays(pa.array([w]), lower=False)
            seen[w] = int(one.hashes[0]), int(shape_hashes(one)[0])
    h = [seen[w][0] for w in words]
    s = [int(qc._REPEAT) if i and h[i] == h[i - 1] else seen[w][1] for i, w in enumerate(words)]
    grams = [(0, mixed(x)) for x in h]
    grams += [(1, joined(a, b)) for a, b in zip(h, h[1:])]
    grams += [(2, joined(joined(a, b), c)) for a, b, c in zip(s, s[1:], s[2:])]
    return Counter((family, x % qc.BUCKETS) for family, x in grams)


def plain_verdicts(rows, quality):
    """Log weight, key and verdict of each row (id, text, 64-bit hash)."""
    seen = {}
    grams = [plain_grams(text, seen) for _, text, _ in rows]
    raw, good = Counter(), Counter()
    for (i, _, _), g in zip(rows, grams):
        raw += g
        if quality.get(i) == 1:
            good += g
    n = [sum(c for (family, _), c in raw.items() if family == f) for f in range(3)]
    m = [sum(c for (family, _), c in good.items() if family == f) for f in range(3)]

    def ratio(gram):
        prior = (raw[gram] + 1) / (n[gram[0]] + qc.BUCKETS)
        return math.log((good[gram] + qc.BUCKETS * prior) / (m[gram[0]] + qc.BUCKETS) / prior)

    weights = [sum(c * ratio(g) for g, c in one.items()) for one in grams]
    share = sum(q == 1 for q in quality.values()) / len(quality)
    k = sum(share * math.exp(min(w, 50.0)) >= qc.MIN_POSTERIOR for w in weights)
    keys = [w - math.log(-math.log((((x & ALL) >> 11) + 0.5) / 2**53)) for w, (_, _, x) in zip(weights, rows)]
    least = sorted(keys, reverse=True)[k - 1]
    return weights, keys, [key >= least for key in keys]


def test_against_plain_counts_and_a_plain_draw(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.lit(qc.SEED), "doc_id", "text")).collect()]
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert len(quality) == labels.where("quality IS NOT NULL").count() <= qc.MAX_LABELLED
    found = {r.doc_id: r for r in qc.classify(docs, labels)[0].collect()}
    assert len(found) == len(rows)
    weights, keys, kept = plain_verdicts(rows, quality)
    assert [found[i].log_weight for i, _, _ in rows] == pytest.approx(weights, rel=1e-9, abs=1e-6)
    assert [found[i].key for i, _, _ in rows] == pytest.approx(keys, rel=1e-9, abs=1e-6)
    assert [found[i].kept for i, _, _ in rows] == kept and 0 < sum(kept) < len(kept)


def test_mixing_of_hashes_is_that_of_the_arrays():
    from tally.llm import common

    x = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    assert [mixed(int(v)) for v in x] == [int(v) for v in common.mixed(x)]
