"""Repeated windows of the quality rules: sorted without an expression per comparison, counted as by hand."""

import random

from tally.llm import quality_rules
from tally.llm.common import split_words


def by_hand(text):
    words = split_words(text, lower=False)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(inside)


def test_repeats_are_sorted_by_the_engine_and_counted_whole(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "a " * 12, "a\tb " * 9]
    texts += [" ".join(rng.choices("xyz", k=rng.randrange(1, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = quality_rules.judge_documents(df)
    assert "array_sort(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["n_repeat_words"] for r in out.collect()} == {i: by_hand(t) for i, t in enumerate(texts)}
