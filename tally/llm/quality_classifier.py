"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Three families of n-grams are hashed into buckets: words, word pairs, and triples of word shapes (a
shape says which kinds of characters follow each other, and whether the word repeats the one before).
The raw model counts all documents, the target model the good ones of a bounded labelled sample. A
text's log weight is the sum of log ratios of its n-grams. The size k of the selection is the number
of documents whose posterior, share of good labels times weight, is at least ``MIN_POSTERIOR``; the k
largest log weights, each plus Gumbel noise from a hash of the row, are a draw of k documents without
replacement in proportion to their weights.

Defined results: null and empty texts have no n-grams and a log weight of 0; labels that are null or
contradict each other are not used; without good labels all weights are 1; rows equal in id and text
get equal noise and stay or go together; an empty table gives an empty table. Other columns are not
read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import mixed, small_batches, table
from tally.llm.registry import query
from tally.llm.wordarrays import shape_hashes, word_arrays
from tally.session import stage

BUCKETS = 1 << 14
FAMILIES = 3
MAX_LABELLED = 20_000
MIN_POSTERIOR = 0.05
SEED = 7
BINS = 1_024

_MUL = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x517CC1B727220A95)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (of all families) and row of every n-gram of a text column."""
    words = word_arrays(column, lower=False)
    h, s, owner = words.hashes, shape_hashes(words), words.row
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    s = np.where(again, _REPEAT, s)
    pair = mixed(h[:-1] * _MUL + h[1:])
    triple = mixed(mixed(s[:-2] * _MUL + s[1:-1]) * _MUL + s[2:])
    found, owners = [], []
    for family, grams in enumerate((mixed(h), pair, triple)):
        reach = len(h) - len(grams)
        inside = owner[: len(grams)] == owner[reach:]
        found.append((grams[inside] % np.uint64(BUCKETS)).astype(np.int64) + family * BUCKETS)
        owners.append(owner[: len(grams)][inside])
    return np.concatenate(found), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: of each bucket in all texts and in the good ones."""
    raw, good = (np.zeros(FAMILIES * BUCKETS, np.int64) for _ in range(2))
    for batch in small_batches(batches):
        grams, owner = ngrams(batch.column("text"))
        raw += np.bincount(grams, minlength=len(raw))
        target = np.array(batch.column("good").to_pylist(), bool)
        if target.any():
            good += np.bincount(grams[target[owner]], minlength=len(good))
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], good[used])], names=["bucket", "raw", "good"])


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, by the order of a hash: (``label_id, quality``). That is the bound for sending it to tasks."""
    per = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
    per = per.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    chosen = per.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)
    return chosen.select(F.col("doc_id").alias("label_id"), "quality")


class Model:
    """Log ratios by bucket, of fixed length, and the share of good labels."""

    def __init__(self, ratios: np.ndarray, share: float):
        self.ratios, self.share = ratios, share

    def log_weight(self, text: Column) -> Column:
        ratios = self.ratios

        @F.arrow_udf("double")
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                sums = []
                for k in range(0, len(texts), 1_000):
                    part = texts.slice(k, 1_000)
                    grams, owner = ngrams(part)
                    sums.append(np.bincount(owner, weights=ratios[grams], minlength=len(part)))
                yield pa.array(np.concatenate(sums) if sums else np.empty(0))

        return weigh(text)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Count both models in one pass over all documents."""
    sample = stage(labelled_sample(labels), "labelled")
    good, known = sample.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    docs = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left")
    docs = docs.select("text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
    counts = docs.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket")
    raw, target = (np.zeros(FAMILIES * BUCKETS) for _ in range(2))
    # At most FAMILIES * BUCKETS rows, whatever the input.
    for row in counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toLocalIterator():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["good"]
    if not good or not target.any():
        return Model(np.zeros(FAMILIES * BUCKETS), 1.0)
    ratios = []
    for p, q in zip(np.split(target, FAMILIES), np.split(raw, FAMILIES)):
        prior = (q + 1) / (q.sum() + BUCKETS)
        # The target is smoothed towards the raw model, with the weight of one count a bucket.
        ratios.append(np.log((p + BUCKETS * prior) / (p.sum() + BUCKETS)) - np.log(prior))
    return Model(np.concatenate(ratios), good / known)


def gumbel_key(log_weight: Column) -> Column:
    """The log weight plus Gumbel noise that depends on the row's id and text alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return log_weight - F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, found by counting bins and counting again inside the bin that holds it.

    The driver sees ``BINS`` counts a round and at last at most ``BINS`` different values.
    """
    x = F.col(column)
    low, high = values.agg(F.min(x), F.max(x)).first()
    while True:
        inside = values.where((x >= low) & (x <= high))
        width = (high - low) / BINS
        if inside.count() <= BINS or low + width == low:
            for row in sorted(inside.groupBy(x.alias("x")).count().toLocalIterator(), key=lambda r: -r["x"]):
                k -= row["count"]
                if k <= 0:
                    return row["x"]
        place = F.least(F.floor((x - low) / width), F.lit(BINS - 1)).alias("bin")
        bins = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for row in sorted(bins.toLocalIterator(), key=lambda r: -r["bin"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]


def classify(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model, float]:
    """Per document the log weight, posterior, key and verdict; the model; the least key that is kept."""
    model = fit(documents, labels)
    scored = documents.select("doc_id", "text", model.log_weight(F.col("text")).alias("log_weight"))
    posterior = F.least(F.lit(1.0), F.lit(model.share) * F.exp(F.least("log_weight", F.lit(50.0))))
    scored = scored.select("doc_id", "log_weight", posterior.alias("posterior"), gumbel_key(F.col("log_weight")).alias("key"))
    scored = stage(scored, "weighed")
    k = scored.where(F.col("posterior") >= MIN_POSTERIOR).count()
    least = kth_largest(scored, "key", k) if k else float("inf")
    return scored.withColumn("kept", F.col("key") >= least), model, least


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, as they are."""
    _, model, least = classify(documents, labels)
    return documents.where(gumbel_key(model.log_weight(F.col("text"))) >= least)


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
