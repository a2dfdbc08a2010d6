"""Line dedup by winnowing over line hashes.

Blank lines aside, of every window of ``LINES`` lines the line of the least hash is selected, the last of equals, so
two texts that share a window select the same line of it. Selected lines are the fingerprints: they alone are joined,
those that stand once fall out, and around each of the others the windows that selected it are compared with the
first of their kind. So a match reaches from the selected line to both sides; matches with the same earlier text at the
same distance that overlap grow into one run, and the lines of all runs but the first are deleted. A run of ``LINES``
lines or more that repeats is always found; a shorter one in a longer text is not, as in the SQL twin.

Texts are ordered by id (null first), then text hash; a run is later if it begins further on in that
order. Defined results: null and empty texts have no lines and stay as they are (a null as an empty
text); a text with fewer lines than a window is one window and repeats only a text as short; rows
equal in id and text are one text, so neither is the later; of equal lines of one window the last is selected; a very
long text is read whole, and its fingerprints leave the task in batches of about ``BATCH`` windows and one text; an
empty table gives an empty table. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import shingle_hashes, small_batches, table
from tally.llm.registry import query
from tally.session import stage

LINES = 3
BATCH = 200_000
_BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text_hash long, fingerprint long, windows array<struct<window: long, at: int, until: int>>"


def winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its minimum, the last of equals; never falling."""
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    return np.arange(len(view)) + (width - 1 - view[:, ::-1].argmin(1))


def line_hashes(lines: list[str]) -> np.ndarray:
    """A 64-bit hash of each line. None is kept: lines are as long as texts may be, and seldom come again."""
    return np.fromiter((xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines), np.uint64, len(lines))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each selected line: its hash, and hash, first and last line of each window that selected it."""

    def batch_of(batch: pa.RecordBatch, rows: dict[str, list]) -> pa.RecordBatch:
        parts = {c: np.concatenate(v) for c, v in rows.items()}
        size = parts.pop("size")
        own = pa.array(parts.pop("row"))
        windows = pa.StructArray.from_arrays([pa.array(parts[c]) for c in ("window", "at", "until")], ["window", "at", "until"])
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array(parts["fingerprint"])]
            + [pa.ListArray.from_arrays(ends, windows)],
            names=["doc_id", "text_hash", "fingerprint", "windows"],
        )

    names = ("row", "fingerprint", "size", "window", "at", "until")
    for batch in small_batches(batches):
        rows: dict[str, list] = {c: [] for c in names}
        held = 0
        for k, text in enumerate(batch.column("text")):
            lines = [(i, line) for i, line in enumerate((text.as_py() or "").split("\n")) if line.strip(_BLANK)]
            if not lines:
                continue
            at = np.array([i for i, _ in lines], np.int32)
            h = line_hashes([line for _, line in lines])
            width = min(LINES, len(h))
            chosen = winnowed(h, width)
            begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
            rows["row"].append(np.full(len(begin), k))
            rows["fingerprint"].append(h[chosen[begin]].view(np.int64))
            rows["size"].append(np.diff(begin, append=len(chosen)))
            rows["window"].append(shingle_hashes(h, width).view(np.int64))
            rows["at"].append(at[: len(chosen)])
            rows["until"].append(at[width - 1 :])
            held += len(chosen)
            if held >= BATCH:
                yield batch_of(batch, rows)
                rows, held = {c: [] for c in names}, 0
        if held:
            yield batch_of(batch, rows)


def repeated_runs(documents: DataFrame) -> DataFrame:
    """Rows (``doc_id, text_hash, begin, end, first_doc_id, first_begin``): runs of lines that stand earlier, too."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    selected = stage(docs.mapInArrow(_fingerprints, SCHEMA), "fingerprints")
    # Staged, so that both sides of the joins are plain shuffles and a line that stands everywhere can be split.
    often = selected.groupBy("fingerprint").agg(F.count("*").alias("times")).where("times > 1").select("fingerprint")
    often = stage(often, "often")
    shared = selected.join(often, "fingerprint", "left_semi")
    windows = stage(shared.select("doc_id", "text_hash", "fingerprint", F.inline("windows")), "windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "text_hash", "at")
    key = ["fingerprint", "window"]
    first = windows.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = stage(first.drop("times"), "first")
    # Rows of one text given twice lie at the same place, so neither is later.
    later = windows.join(first, key).where(place > F.col("first"))
    later = later.withColumn("shift", F.col("at") - F.col("first.at"))
    same = ["doc_id", "text_hash", "first.doc_id", "first.text_hash", "shift"]
    along = Window.partitionBy(*same).orderBy("at")
    fresh = F.when(F.col("at") <= F.lag("until").over(along), 0).otherwise(1)
    later = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    runs = later.groupBy(
        "doc_id", "text_hash", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_hash"),
        "shift", "run",
    )
    return runs.agg(
        F.min("at").alias("begin"), F.max("until").alias("end"), F.min("first.at").alias("first_begin")
    ).drop("shift", "run")


def deduplicated(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: id, number of lines with a word, how many were deleted, and the text that is left."""
    runs = repeated_runs(documents).groupBy("doc_id", "text_hash")
    runs = runs.agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs"))
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<begin:int,end:int>>"),
        lambda a, r: F.when(
            (F.size(a) > 0) & (r["begin"] <= F.get(a, F.size(a) - 1)["end"] + 1),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(
                    F.struct(
                        F.get(a, F.size(a) - 1)["begin"].alias("begin"),
                        F.greatest(F.get(a, F.size(a) - 1)["end"], r["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(a, F.array(r))),
    )
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), merged.alias("runs"))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    docs = docs.join(runs, same, "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    inside = lambda i: F.exists("runs", lambda r: (i >= r["begin"]) & (i <= r["end"]))
    full = lambda x: F.size(F.filter(x, lambda line: F.length(F.translate(line, _BLANK, "")) > 0)).cast("long")
    left = F.when(F.col("runs").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~inside(i)))
    docs = docs.withColumn("left", left)
    return docs.select(
        "doc_id", full("lines").alias("n_lines"), (full("lines") - full("left")).alias("n_deleted"),
        F.array_join("left", "\n").alias("clean_text"),
    )


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
f AS (SELECT doc_id, list(line ORDER BY i) AS ls, list(i ORDER BY i) AS pos FROM l
      WHERE length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0 GROUP BY doc_id),
w AS (SELECT doc_id, ls[k:k + least(3, len(ls)) - 1] AS g, pos[k] AS a, pos[k + least(3, len(ls)) - 1] AS b
      FROM (SELECT *, unnest(range(1, len(ls) - least(3, len(ls)) + 2)) AS k FROM f)),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS x,
             count(*) FILTER (length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS n
      FROM l LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_deleted,
       length(coalesce(x, ''))::BIGINT AS clean_chars, md5(coalesce(x, '')) AS clean_md5
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark, sf_dir):
    clean = deduplicated(table(spark, sf_dir, "documents"))
    return clean.select(
        "doc_id", "n_lines", "n_deleted", F.length("clean_text").cast("long").alias("clean_chars"),
        F.md5(F.encode("clean_text", "UTF-8")).alias("clean_md5"),
    )
