"""Line hashes hold nothing of the lines a task has seen."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tally.llm import line_dedup
from tally.llm.common import WordHashes


def batches(n):
    for k in range(n):
        texts = [f"{k} {i} " + "x" * 20_000 for i in range(50)]
        ids = np.arange(50) + 50 * k
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], names=["doc_id", "text_hash", "text"])


def peak(n):
    tracemalloc.start()
    rows = sum(b.num_rows for b in line_dedup._fingerprints(batches(n)))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 50 * n
    return top


def test_memory_does_not_grow_with_the_lines_seen():
    peak(1)  # what the first call imports
    assert peak(40) < 2 * peak(4)


def test_hashes_are_those_of_before():
    lines = ["", "a", "é ü", "x" * 5000, "\ud800"]
    assert (line_dedup.line_hashes(lines) == WordHashes().of(lines)).all()
