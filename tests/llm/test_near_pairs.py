"""Components of many near copies, and how many pairs are formed for them."""

import numpy as np

from tally.llm import jaccard_join
from tally.llm.common import split_words

WIDTH, PERCENT = 5, 75


def variants(rng, n, words, fewest, most):
    """Copies of one text, each with some words replaced: some link with others and some are just too far from all."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(words, rng.integers(fewest, most + 1), replace=False):
            text[at] = f"n{k}_{at}" if rng.random() < 0.5 else f"s{at}_{rng.integers(3)}"
        out.append(" ".join(text))
    return out


def components(texts):
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append({tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set())
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and sets[a] and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_have_their_components_and_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = variants(rng, 240, 120, 2, 9) + variants(rng, 60, 40, 1, 4)[::-1] + ["", " ", "one two"]
    formed = []
    stage = jaccard_join.stage

    def counted(df, label="stage", **more):
        out = stage(df, label, **more)
        if label == "near":
            formed.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(texts))] == components(texts)
    # What stays apart after the rounds of hubs is not brought to the whole sets in all its pairs.
    assert formed[-1] < len(texts)


def test_pairs_of_the_last_turn_are_formed_once_for_all_their_keys(spark):
    parts = [1, 2, 0, 3]
    rows = [(h, f, 6, h, f, list(range(h)), parts) for f in (1, 2, 3) for h in range(3)]
    far = [(h, 9, 6, h, 9, list(range(h)), [0, 0, 6, 0]) for h in range(3)]
    schema = "h long, f long, n int, pos int, comp long, before array<long>, parts array<int>"
    found = jaccard_join._rest(spark.createDataFrame(rows + far, schema))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (2, 3)]
