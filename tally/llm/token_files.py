"""Token ids as Parquet lists: dictionary or delta encoding, small row groups, page indexes, rows by id.

Layout of the files: columns ``part, doc_id, start, n_tokens, ids`` in ascending (doc_id, text hash)
order, null ids first; ``start`` counts from the beginning of the part, so parts are written
independently and :func:`token_index` adds the few part offsets at reading. ``ids`` is dictionary
encoded (a vocabulary of 49k ids takes 16 bits a token before compression), the sorted ``doc_id`` and
``start`` are delta encoded. Row groups and pages are small, and both carry minima and maxima, so a
reader of a doc_id range skips the rest, and one that wants lengths reads no ids.

Defined results: a null or empty text is the end id alone; repeated rows are written each; an empty
table gives files without rows. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm.common import small_batches, table
from tally.llm.registry import query
from tally.llm.wordarrays import WordArrays, word_arrays
from tally.session import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
CACHE_CHUNKS = 1_000_000
LOT = 500
SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"
# White space ends a piece of text for the tokenizer, which drops it and never looks across it; these four
# are that for it and for us.
_BREAKS = (32, 9, 10, 13)
# Fixed value: how the public word tokenizer cuts a text. It never puts a letter or digit and a mark in one piece.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkIds:
    """Ids of the pieces of text between white space, each encoded when first met; emptied when it holds many."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        marks = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        # A special token that is cut out of a text as it stands, to set pieces apart in one call.
        self.mark = next(((i, t.content) for i, t in marks if not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.special = [t.content for _, t in marks]
        layout = json.loads(self.tokenizer.to_str())
        # Where the tokenizer is known to do so itself, capitals and last full stops make no new pieces.
        self.folds = "Lowercase" in json.dumps(layout["normalizer"])
        self.stops = json.dumps(_WORD_PATTERN) in json.dumps(layout["pre_tokenizer"])
        self.clear()

    def pieces(self, column: pa.Array) -> WordArrays:
        """The pieces of each text that are encoded on their own."""
        fold = self.folds and not (pa.compute.any(pa.compute.match_substring(column, "<|")).as_py() or False)
        return word_arrays(column, lower=fold, spaces=_BREAKS, stops=self.stops)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece: many in one call with a mark between, those that hold a special token on their own."""
        encode = self.tokenizer.encode_batch_fast
        if self.mark is None:
            return [np.array(e.ids, np.int32) for e in encode(pieces, add_special_tokens=False)]
        own = [any(t in p for t in self.special) for p in pieces]
        alone = iter(encode([p for p, o in zip(pieces, own) if o], add_special_tokens=False))
        rest = [p for p, o in zip(pieces, own) if not o]
        number, mark = self.mark
        lots = [mark.join(rest[k : k + LOT]) for k in range(0, len(rest), LOT)]
        parts: list[np.ndarray] = []
        for e in encode(lots, add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            edges = np.concatenate([[-1], np.flatnonzero(ids == number), [len(ids)]])
            parts += [ids[a + 1 : b] for a, b in zip(edges[:-1], edges[1:])]
        together = iter(parts)
        return [np.array(next(alone).ids, np.int32) if o else next(together) for o in own]

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, words: WordArrays) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all pieces in order, and how many each piece has."""
        if len(self.number) > CACHE_CHUNKS:
            self.clear()
        seen, first, each = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = seen.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.number]
        if new:
            found = self._encoded([words.text(first[k]) for k in new])
            for k in new:
                self.number[keys[k]] = len(self.number)
            size = np.array([len(x) for x in found], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, *found])
        place = np.array([self.number[h] for h in keys], np.int64)[each]
        size = self.size[place]
        begin = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[place] - begin, size) + np.arange(int(size.sum()))], size


@functools.lru_cache(maxsize=1)
def _chunk_ids(tokenizer_path: str) -> ChunkIds:
    """One cache for all tasks that a Python worker runs."""
    return ChunkIds(tokenizer_path)


def _encoder(tokenizer_path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, start = _chunk_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches):
            words = chunks.pieces(batch.column("text"))
            ids, size = chunks.of(words)
            counts = np.bincount(words.row, weights=size, minlength=batch.num_rows).astype(np.int64) + 1
            ends = np.cumsum(counts)
            flat = np.insert(ids, (ends - counts) - np.arange(len(counts)) + counts - 1, end_id)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, np.int32)),
                    batch.column("doc_id"),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids"],
            )
            start += int(counts.sum())

    return encode


def write_token_files(
    documents: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the files under ``path``, which all executors share."""
    ordered = (
        documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))
    )
    (
        ordered.select("doc_id", "text")
        .mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the files, of documents ``first`` to ``last`` where given; row groups and pages outside are skipped."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before each part; one row a part. Reads two columns, no ids."""
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        counts = pa.array(np.diff(at).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("doc_id"), batch.column("start"), counts, pa.array(sums, pa.int64())],
            names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where its ids start among all ids, how many they are, and their crc32."""
    sums = read_tokens(spark, path).select("part", "doc_id", "start", "ids")
    sums = sums.mapInArrow(_sums, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    offsets = part_offsets(spark, path)
    return sums.join(offsets, "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(documents: DataFrame) -> DataFrame:
    """Write the files of ``documents`` to a fresh shared path and return their digest."""
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(documents, path, default_tokenizer())
    return token_digest(spark, path)


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))
