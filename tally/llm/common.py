"""What the operators of this package share: tables, word patterns, word hashes, key bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = {ord(u): l for u, l in zip(UPPER, LOWER)}
# str.split() would also cut at other Unicode space; these six alone separate words.
SPACES = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between blanks and the control characters 9 to 13; null where the text is null."""
    return F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))


def split_words(text: str | None, lower: bool = True) -> list[str]:
    """The words of :func:`space_words`, in Python; A-Z lower-cased on request; none for null."""
    if not text:
        return []
    if lower:
        text = text.translate(LOWER_TABLE) if not text.isascii() else text.lower()
    return [w for w in text.translate(SPACES).split(" ") if w]


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words seen lately; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that sums of products become even in all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows; of the whole sequence where it is shorter; none for no words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * _MUL + words[i : len(words) - width + 1 + i])
    return out


def bitmap_words(df: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """Rows (``at``, ``bits``): 64-bit words of a bitmap in which bit ``key mod 2**log2_bits`` is set.

    At most ``2**(log2_bits - 6)`` rows whatever the input, which is the bound for sending it to tasks.
    """
    slot = F.col(key).bitwiseAND(F.lit((1 << log2_bits) - 1))
    one = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    return (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.bit_or(one).alias("bits"))
    )


def bitmap_array(df: DataFrame, key: str, log2_bits: int) -> np.ndarray:
    """The bitmap of :func:`bitmap_words` as an array; its size is fixed by ``log2_bits`` alone."""
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    words = bitmap_words(df, key, log2_bits).toArrow()
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def small_arrow(spark: SparkSession) -> SparkSession:
    """Send texts to Python a thousand at a time, so that neither side holds many of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that arrays over their words stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may have been put in; false positives only."""
    slot = keys.astype(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
