"""Line dedup against a plain loop over lines, and the guarantee of winnowing."""

import random

import numpy as np
from pyspark.sql import functions as F

from tally.llm import line_dedup


def cleaned_plainly(texts):
    """What is left of each text, in order of ids, when windows that stand earlier are deleted."""
    first, out = set(), {}
    for i, text in sorted(texts.items()):
        lines = (text or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        width, gone = min(line_dedup.LINES, len(full)), set()
        for a in range(len(full) - width + 1 if full else 0):
            window = tuple(lines[k] for k in full[a : a + width])
            if window in first:
                gone.update(range(full[a], full[a + width - 1] + 1))
            first.add(window)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def some_texts():
    rng = random.Random(5)
    parts = [[f"line {rng.randrange(30)}" for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    texts = {}
    for i in range(150):
        lines = [line for _ in range(rng.randrange(1, 6)) for line in rng.choice(parts) + [""] * rng.randrange(2)]
        texts[i] = "\n".join(lines[rng.randrange(3) :])
    return texts | {150: None, 151: "", 152: " \n\t", 153: "menu\n" * 40, 154: "menu\n" * 2, 155: "menu\nmenu"}


def test_what_is_left_is_that_of_a_plain_loop(spark):
    texts = some_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = cleaned_plainly(texts)
    assert {r.doc_id: r.clean_text for r in line_dedup.deduplicated(docs).collect()} == want
    twice = docs.union(docs.where("doc_id % 3 = 0"))
    found = line_dedup.deduplicated(twice).collect()
    assert len(found) == twice.count() and all(r.clean_text == want[r.doc_id] for r in found)


def test_small_batches_hold_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame(list(some_texts().items()), "doc_id long, text string")
    plain = line_dedup._fingerprints
    monkeypatch.setattr(line_dedup, "BATCH", 10)
    batch = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").toArrow().combine_chunks().to_batches()
    small = list(plain(iter(batch)))
    monkeypatch.setattr(line_dedup, "BATCH", 10**9)
    large = list(plain(iter(batch)))
    assert len(small) > 10 and len(large) == 1
    assert [r for b in small for r in b.to_pylist()] == large[0].to_pylist()


def test_shared_windows_select_the_same_line():
    rng = np.random.default_rng(3)
    for _ in range(200):
        h = rng.integers(0, 8, 40).astype(np.uint64)
        chosen = line_dedup.winnowed(h, 3)
        assert (np.diff(chosen) >= 0).all()
        for a, c in enumerate(chosen):
            window = list(h[a : a + 3])
            assert a <= c < a + 3 and h[c] == min(window) and h[c] not in window[c - a + 1 :]
