"""Hard-negative mining: exact inner products from subset-sum tables, looked up by packed bit planes.

Vectors become integers, ``floor(scale * x)``. An integer in two's complement is a sum of its bits, so
the inner product with an anchor is, plane by plane, the sum of the anchor's components where the plane
has a bit. Eight dimensions at a time, that sum is one of 256, which are tabled per anchor; a byte of
the plane is the place in the table, and planes are added up by doubling (top plane negative). The
index holds the planes of all rows, packed, one small binary a row.

Anchors and rows are dealt to blocks by hash, and a task scores one block of anchors against one block
of rows, so that memory is bounded by the two block sizes whatever the labels are; what leaves a task
is the best few of each anchor. A first pass scores rows of the anchor's label and finds its positives,
a second all rows between the least and the greatest score wanted.

Defined results: rows with a null id, label or vector, or with a null, infinite or missing number in
it, take no part, nor do rows with a component whose integer exceeds 62 bits; shorter vectors count as
zero beyond their end, empty ones as zero; scores are exact where they fit 64 bits. Rows equal in id,
label and integers are one row; rows of one id that differ otherwise are rows of their own. Equal
scores are ordered by id. Anchors without positives, and positives without negatives, return no rows;
empty tables none. Texts are not read, other columns neither, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import small_batches, table
from tally.llm.registry import query
from tally.session import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative has at least this share of the positive's score, in percent, and at most all of it.
LEAST_PERCENT = 80
# Rows and anchors of one task, and anchors scored at a time; tables of 256 sums take 8 * 256 * 4 bytes an anchor at 64 dimensions.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 2048
ANCHORS_AT_ONCE = 128
ROWS_AT_ONCE = 1024
LARGEST = float(1 << 62)


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and the integers of those that do."""
    good, out = np.zeros(len(column), bool), []
    for k, row in enumerate(column):
        if not row.is_valid:
            continue
        x = row.values
        if x.null_count:
            continue
        x = np.floor(scale * x.to_numpy(zero_copy_only=False).astype(np.float64))
        if not (np.abs(x) < LARGEST).all():
            continue
        good[k] = True
        out.append(x.astype(np.int64))
    return good, out


def pack(x: np.ndarray) -> bytes:
    """Bit planes of a row of integers, lowest first, eight dimensions a byte; as few planes as the row needs."""
    planes = max([int(v).bit_length() for v in (x.max(initial=0), ~x.min(initial=-1))]) + 1
    bits = (x[None, :] >> np.arange(planes, dtype=np.int64)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers of rows of planes (rows, planes, bytes)."""
    bits = np.unpackbits(planes, axis=2).astype(np.int64)
    weights = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def _packing(scale: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            good, rows = _integers(batch.column("vector"), scale)
            batch = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("anchor"),
                 pa.array([(len(x) + 7) // 8 for x in rows], pa.int32()), pa.array([pack(x) for x in rows], pa.binary())],
                names=["id", "label", "anchor", "width", "planes"],
            )

    return packed


def index(rows: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(key, id, label, anchor, width, planes)``, one row for each different row that takes part."""
    known = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    schema = "id long, label long, anchor boolean, width int, planes binary"
    packed = known.mapInArrow(_packing(scale), schema).distinct()
    return packed.select(F.xxhash64("id", "label", "width", "planes").alias("key"), "*")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if len(column) else np.empty(0, np.int64)


class _Rows:
    """Rows of a task in the order of their ids, with their planes in lots of one shape."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])
        self.id, self.key, self.label = (_numbers(rows[c]) for c in ("id", "key", "label"))
        width, planes = _numbers(rows["width"]), rows["planes"].to_pylist()
        size = np.array([len(p) for p in planes], np.int64)
        self.lots = []
        for w, s in sorted(set(zip(width.tolist(), size.tolist()))):
            at = np.flatnonzero((width == w) & (size == s))
            if w:
                flat = np.frombuffer(b"".join(planes[k] for k in at), np.uint8)
                self.lots.append((at, flat.reshape(len(at), s // w, w)))

    def integers(self) -> np.ndarray:
        width = max([p.shape[2] for _, p in self.lots], default=0)
        out = np.zeros((len(self.id), width * 8), np.int64)
        for at, planes in self.lots:
            out[at, : planes.shape[2] * 8] = unpack(planes)
        return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``[group, byte, anchor]``: the sum of the anchor's components in the group whose bits the byte has."""
    n, d = anchors.shape
    groups = anchors.reshape(n, d // 8, 8).transpose(1, 2, 0)
    sums = np.zeros((d // 8, 256, n), anchors.dtype)
    for bit in range(8):
        # The first dimension of a group is the highest bit of its byte.
        step = 1 << bit
        sums[:, step : 2 * step] = sums[:, :step] + groups[:, 7 - bit, None, :]
    return sums


def scores(sums: np.ndarray, rows: _Rows, chosen: np.ndarray) -> np.ndarray:
    """``[anchor, row]``: exact inner products of the anchors of the tables with the chosen rows."""
    place = np.full(len(rows.id), -1)
    place[chosen] = np.arange(len(chosen))
    out = np.zeros((sums.shape[2], len(chosen)), sums.dtype)
    for at, planes in rows.lots:
        mine = place[at] >= 0
        at, planes = at[mine], planes[mine]
        groups = min(planes.shape[2], len(sums))
        for k in range(0, len(at), ROWS_AT_ONCE):
            bytes_ = planes[k : k + ROWS_AT_ONCE].astype(np.intp)
            total = np.zeros((len(bytes_), sums.shape[2]), sums.dtype)
            found = np.empty_like(total)
            for p in range(bytes_.shape[1] - 1, -1, -1):
                total += total
                for g in range(groups):
                    np.take(sums[g], bytes_[:, p, g], axis=0, out=found, mode="clip")
                    if p == bytes_.shape[1] - 1:
                        total -= found
                    else:
                        total += found
            out[:, place[at[k : k + ROWS_AT_ONCE]]] = total.T
    return out


def _exact(anchors: np.ndarray, rows: _Rows) -> np.ndarray:
    """The anchors in 32 bits where no sum can leave them, else in 64."""
    bits = max([p.shape[1] for _, p in rows.lots], default=1)
    largest = max(abs(int(anchors.max(initial=0))), abs(int(anchors.min(initial=0))))
    return anchors.astype(np.int32) if anchors.shape[1] * largest << bits < 1 << 31 else anchors


def _first(rank: np.ndarray, score: np.ndarray, column: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """Of hits sorted by anchor, score and id: the places of the first ``most`` of each anchor among those that are ``ok``."""
    so_far = np.cumsum(ok)
    start = np.searchsorted(rank, rank, side="left")
    before = np.where(start > 0, so_far[start - 1], 0)
    return np.flatnonzero(ok & (so_far - before <= most))


def _ordered(s: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The wanted cells by anchor, falling score and column (which is the order of ids)."""
    r, c = np.nonzero(wanted)
    found = s[r, c].astype(np.int64)
    order = np.lexsort((c, ~found, r))
    return r[order], found[order], c[order]


def _best(s: np.ndarray, most: int) -> np.ndarray:
    """Cells that can be among the ``most`` best of a row; of equal ones the first."""
    if s.shape[1] <= most:
        return np.ones(s.shape, bool)
    least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most, None]
    same = s == least
    return (s > least) | (same & (np.cumsum(same, axis=1) <= most))


def _positives(most: int):
    """The best rows of each anchor's own label in one block of rows."""

    def found(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = _Rows(rows), _Rows(anchors)
        vectors = _exact(anchors.integers(), rows)
        out = [[], [], [], []]
        for label in np.unique(anchors.label):
            own, mine = np.flatnonzero(rows.label == label), np.flatnonzero(anchors.label == label)
            for k in range(0, len(mine) if len(own) else 0, ANCHORS_AT_ONCE):
                part = mine[k : k + ANCHORS_AT_ONCE]
                s = scores(subset_sums(vectors[part]), rows, own)
                # One more than wanted, as the anchor itself may be among them.
                r, score, c = _ordered(s, _best(s, most + 1))
                other = rows.key[own[c]] != anchors.key[part[r]]
                at = _first(r, score, c, other, most)
                for column, values in zip(out, (anchors.key[part[r[at]]], score[at], rows.id[own[c[at]]], rows.key[own[c[at]]])):
                    column.append(values)
        return _table(out, ["anchor_key", "score", "id", "key"])

    return found


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in zip(names, columns)})


def _negatives(most: int, percent: int):
    """For each positive of an anchor, the best rows of other labels in one block of rows."""

    def found(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        given = {k: p for k, p in zip(anchors["key"].to_pylist(), anchors["positives"].to_pylist())}
        rows, anchors = _Rows(rows), _Rows(anchors.drop_columns(["positives"]))
        vectors = _exact(anchors.integers(), rows)
        every = np.arange(len(rows.id))
        out = [[], [], [], [], []]
        for k in range(0, len(anchors.id), ANCHORS_AT_ONCE):
            part = slice(k, k + ANCHORS_AT_ONCE)
            keys = anchors.key[part]
            lists = [given[key] for key in keys.tolist()]
            width = max(map(len, lists))
            # Of a positive's score p, at least percent p / 100 rounded up; a place without a positive wants nothing.
            high = np.array([[x["score"] for x in p] + [-1] * (width - len(p)) for p in lists], np.int64)
            name = np.array([[x["key"] for x in p] + [0] * (width - len(p)) for p in lists], np.int64)
            low = np.where(high < 0, 0, high - ((high // 100) * (100 - percent) + (high % 100) * (100 - percent) // 100))
            s = scores(subset_sums(vectors[part]), rows, every)
            least = np.where(high < 0, np.iinfo(np.int64).max, low).min(axis=1)
            wanted = (s >= least[:, None]) & (s <= high.max(axis=1)[:, None])
            wanted &= anchors.label[part][:, None] != rows.label[None, :]
            r, score, c = _ordered(s, wanted)
            for j in range(width):
                at = _first(r, score, c, (score <= high[r, j]) & (score >= low[r, j]), most)
                for column, values in zip(out, (keys[r[at]], name[r[at], j], score[at], rows.id[c[at]], rows.key[c[at]])):
                    column.append(values)
        return _table(out, ["anchor_key", "positive_key", "score", "id", "key"])

    return found


def _scored(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, fn, schema: str) -> DataFrame:
    """``fn`` over each block of rows with each block of anchors."""
    row_blocks, anchor_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_anchors // ANCHOR_BLOCK) or 1
    of_rows = F.pmod("key", F.lit(row_blocks)).cast("int")
    of_anchors = F.pmod(F.xxhash64("key"), F.lit(anchor_blocks)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select(of_rows.alias("rb"), all_of(anchor_blocks).alias("ab"), "key", "id", "label", "width", "planes")
    right = anchors.select(all_of(row_blocks).alias("rb"), of_anchors.alias("ab"), *anchors.columns)
    # As many partitions as blocks, so that small blocks that are dear to score do not end in one task.
    parts = min(row_blocks * anchor_blocks, 20_000)
    left, right = (x.repartition(parts, "rb", "ab").groupBy("rb", "ab") for x in (left, right))
    return left.cogroup(right).applyInArrow(fn, schema)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """For each row where ``anchor`` holds and each of its best ``positives``, the best ``negatives`` in the window of scores."""
    rows = stage(index(rows, anchor, id_col, vector_col, label_col, scale), "planes")
    # Named anew, so that rows and anchors of one table can meet.
    anchors = rows.where("anchor").select(*[F.col(c).alias(c) for c in rows.columns if c != "anchor"])
    n_rows, n_anchors = rows.count(), anchors.count()
    best = _scored(rows, anchors, n_rows, n_anchors, _positives(positives), "anchor_key long, score long, id long, key long")
    order = [F.desc("score"), F.asc("id"), F.asc("key")]
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("anchor_key").orderBy(*order)))
    best = stage(best.where(F.col("r") <= positives).drop("r"), "positives")
    given = best.groupBy(F.col("anchor_key").alias("key")).agg(F.collect_list(F.struct("score", "key")).alias("positives"))
    found = _scored(
        rows, anchors.join(given, "key"), n_rows, n_anchors, _negatives(negatives, least_percent),
        "anchor_key long, positive_key long, score long, id long, key long",
    )
    place = F.row_number().over(Window.partitionBy("anchor_key", "positive_key").orderBy(*order))
    found = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    names = best.select(
        "anchor_key", F.col("key").alias("positive_key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = anchors.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id"))
    return found.join(names, ["anchor_key", "positive_key"]).join(ids, "anchor_key").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
