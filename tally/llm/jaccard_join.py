"""N-gram Jaccard join: rare-first prefixes, length, position and suffix filters, each pair verified once.

A document is the set of its distinct word shingles; texts with equal sets are one class, and only
classes are joined. Shingles are ordered by how full their bucket of a corpus-wide count is, rarest
first (any order that all documents share gives right results). Two sets link only if their prefixes
share a shingle; lengths, positions in the order and a 256-way partition of the sets bound the
overlap of such a pair from above, and what passes is verified on the whole sets.

Links are wanted for their components, so pairs inside one component need no look: in each group of
sets that share a prefix shingle, all are first paired with a few of them, round by round, and only
pairs that still lie in different components are looked at last. These are formed at the first shingle
that both hold, and only if the bounds let them link, so that groups of copies cost rows in proportion to
their members and to what is nearly a link; no link between components is lost.

Shingles and sets are told apart by 64-bit hashes. Defined results: null, empty and blank texts have
no shingles and link with nothing, not even each other; fewer words than a shingle make one; repeated
rows are in one component; a null id is never the name of a component that has another; an empty table
gives an empty table. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import bitmap_array, in_bitmap, small_batches, table
from tally.llm.registry import query
from tally.llm.wordarrays import window_hashes, word_arrays
from tally.session import stage

WIDTH = 5
PERCENT = 75
RARITY_BITS = 22
SLICE = 1 << 16
# How many sets of a group all others are paired with, round by round, before what is left is joined pair by pair.
HUBS = (1, 3)
# Bits of the bitmaps of shingles that may be shared and of texts whose sets are wanted; false positives cost time only.
SHARED_BITS = 26
TEXT_BITS = 22
SUFFIX_PARTS = 256
# Of so many first keys a set tells which it holds before one, so that most pairs are formed at one key alone.
KEYS_BEFORE = 64


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    windows, at = window_hashes(word_arrays(column), WIDTH)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        s = np.sort(windows[a:b])
        fresh = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=fresh[1:])
        out.append(s[fresh])
    return out


def _fingerprint(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the end of the task its bucket counts in slices of fixed length."""
    names = ["doc_id", "text_hash", "n", "f", "parts", "slice", "counts"]
    counts = np.zeros(1 << RARITY_BITS, np.int32)
    mask = np.uint64(len(counts) - 1)
    kind = pa.list_(pa.int32())
    for batch in small_batches(batches):
        sets = shingle_sets(batch.column("text"))
        place, times = np.unique(np.concatenate(sets) & mask, return_counts=True)
        counts[place.astype(np.int64)] += times.astype(np.int32)
        k = len(sets)
        shift = np.uint64(65 - SUFFIX_PARTS.bit_length())
        parts = [np.bincount((s >> shift).astype(np.int64), minlength=SUFFIX_PARTS).astype(np.int32) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()), pa.array(parts, kind),
             pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
            names=names,
        )
    slices = counts.reshape(-1, SLICE)
    k = len(slices)
    none = pa.nulls(k, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, none, pa.nulls(k, kind), pa.array(np.arange(k, dtype=np.int32)),
         pa.array([zlib.compress(p.tobytes(), 1) for p in slices], pa.binary())],
        names=names,
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counts of each slice, as rarity: steps of a twelfth of an octave."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            more = np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
            total[k] = total[k] + more if k in total else more.astype(np.int64)
    ranks = [np.floor(12 * np.log2(t + 1.0)).astype(np.uint16).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["slice", "ranks"])


def rarity_table(profile: DataFrame) -> np.ndarray:
    """How often each bucket of shingles occurs, on a log scale; of fixed length."""
    sums = profile.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    out = np.zeros((1 << RARITY_BITS) // SLICE * SLICE, np.uint16).reshape(-1, SLICE)
    for row in sums.mapInArrow(_added, "slice int, ranks binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["ranks"], np.uint16)
    return out.ravel()


def _prefixes(rarity_: Broadcast, shared_: Broadcast | None):
    """Prefix shingles of each set; with ``shared_``, only those that its bitmap says another set may have, too."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, shared = rarity_.value, shared_ and shared_.value
        mask = np.uint64(len(rarity) - 1)
        done = set()
        for batch in small_batches(batches):
            keys, owners, sizes, places = ([np.empty(0, t)] for t in (np.int64, np.int64, np.int32, np.int32))
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                f = _fingerprint(s)
                if not n or f in done:  # copies within a task have the same rows
                    continue
                done.add(f)
                k = n - (PERCENT * n + 99) // 100 + 1
                rank = rarity[(s & mask).astype(np.int64)]
                # s ascends, so a stable sort by rarity orders by rarity, then hash.
                first = s[np.argsort(rank, kind="stable")[:k]].view(np.int64)
                at = np.arange(k, dtype=np.int32)
                if shared is not None:
                    some = in_bitmap(shared, first)
                    first, at = first[some], at[some]
                keys.append(first)
                owners.append(np.full(len(first), f, np.int64))
                sizes.append(np.full(len(first), n, np.int32))
                places.append(at)
            columns = [np.concatenate(x) for x in (keys, owners, sizes, places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "f", "n", "pos"])

    return prefixes


def _sets(bitmap: np.ndarray):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in small_batches(batches):
            keys = batch.column("text_hash").to_numpy(zero_copy_only=False)
            found = []
            for s in shingle_sets(batch.filter(pa.array(in_bitmap(bitmap, keys))).column("text")):
                f = _fingerprint(s)
                if len(s) and f not in done:
                    done.add(f)
                    found.append((f, s.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))],
                names=["f", "shingles"],
            )

    return sets


def _needed(na: Column, nb: Column) -> Column:
    """The least overlap of sets of these sizes that link."""
    return F.ceil(F.lit(PERCENT) * (na + nb) / F.lit(100 + PERCENT))


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Length and position filters for a shared prefix shingle at ``pa_`` and ``pb``."""
    lengths = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return lengths & (most >= _needed(na, nb))


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Each pair with the columns of both its sets, named ``_a`` and ``_b``."""
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("f").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def _parts_allow(na: Column, parts_a: Column, nb: Column, parts_b: Column) -> Column:
    """Whether sets could overlap enough by how many shingles each has in every part of the hash range."""
    bound = F.aggregate(F.zip_with(parts_a, parts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return bound >= _needed(na, nb)


def suffix_filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets could overlap enough, by their lengths and parts."""
    both = _sides(pairs, classes, "n", "parts")
    return both.where(_parts_allow(*map(F.col, ("n_a", "parts_a", "n_b", "parts_b")))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) that link, on the whole sets."""
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    n = F.size("shingles_a") + F.size("shingles_b")
    full = _sides(pairs, sets, "shingles").select("a", "b", n.alias("n"), both.alias("both"))
    return full.where(100 * F.col("both") >= PERCENT * (F.col("n") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for all nodes of ``links`` (``a, b``): large-star and small-star until all edges are stars."""
    edges = links.where("a <> b").distinct()
    while True:
        # Large star: what lies above u hangs below the least neighbour of u.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: what lies below u, and u itself, hangs below the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stage(small, "edges")
        # Edges point from the greater end to the less. All is done when none starts where another ends, or twice.
        twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if twice.union(inner).isEmpty():
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
            )


def _pairs_and_groups(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of keys that just two sets hold, filtered; and the rows of keys that more sets hold, each a component of its own.

    Most keys that are shared by chance are of the first kind, and done with at once.
    """
    entry = F.struct("f", "n", "pos")
    held = shared.groupBy("h").agg(F.count("*").alias("c"), F.min(entry).alias("x"), F.max(entry).alias("y"))
    held = stage(held.where("c > 1"), "held")
    near = _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    alone = held.where("c = 2").where(near).select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).distinct()
    many = shared.join(held.where("c > 2").select("h"), "h", "left_semi").withColumn("comp", F.col("f"))
    return alone, stage(many, "many")


def _still_apart(rows: DataFrame) -> DataFrame:
    """The rows of keys that still hold two components, written anew: the others have no pair left to look at."""
    rows = stage(rows, "placed")
    apart = rows.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
    return stage(rows.join(apart, "h", "left_semi"), "apart")


def _about() -> Column:
    return F.floor(F.log("n") / np.log(100 / PERCENT)).cast("int").alias("about")


def _hubs(rows: DataFrame, turn: int) -> DataFrame:
    """A few sets of each shingle and length, where components meet."""
    # Fingerprints are random, and so is their order under a mask; each turn and each choice has another.
    masks = [F.lit((0x9E3779B97F4A7C15 * (8 * turn + k)) % (1 << 63)) for k in range(HUBS[turn])]
    entry = F.struct("f", "n", "pos", "comp")
    hubs = rows.groupBy("h", _about()).agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.array_distinct(F.array(*[F.min_by(entry, F.col("f").bitwiseXOR(m)) for m in masks])).alias("hubs"),
    )
    return hubs.where("low < high").select("h", F.inline("hubs"))


def _pairs(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
    """Pairs of sets in different components that share a shingle, could link by length and position, and pass ``also``."""
    x, y = x.alias("x"), y.alias("y")
    differ = (F.col("x.h") == F.col("y.h")) & (F.col("x.f") != F.col("y.f")) & (F.col("x.comp") != F.col("y.comp"))
    near = _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    pairs = x.join(y, differ & near & also)
    return pairs.select(F.least("x.f", "y.f").alias("a"), F.greatest("x.f", "y.f").alias("b")).distinct()


def _with_parts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with the first keys that the set holds before theirs, and with the parts of the set."""
    sets = rows.groupBy("f").agg(
        F.first("n").alias("n"), F.first("comp").alias("comp"), F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("held")
    )
    sets = sets.join(classes.select("f", "parts"), "f")
    some = F.slice(F.col("held.h"), F.lit(1), F.least(F.col("at"), F.lit(KEYS_BEFORE)))
    rows = sets.select("f", "n", "comp", "parts", "held", F.posexplode("held").alias("at", "key"))
    return rows.select("key.h", "f", "n", "key.pos", "comp", some.alias("before"), "parts")


def _star(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each set with a few of those that share its shingle and are about as long, where components meet."""
    return _pairs(rows, _hubs(rows, turn), F.lit(True))


def _rest(rows: DataFrame) -> DataFrame:
    """All pairs of sets in different components that share a shingle and pass all filters; ``rows`` are of keys that hold such.

    A pair is formed where none of the first keys of both stands before, so always at the first of all that they share.
    """
    once = (F.col("x.f") < F.col("y.f")) & ~F.arrays_overlap("x.before", "y.before")
    return _pairs(rows, rows, once & _parts_allow(*map(F.col, ("x.n", "x.parts", "y.n", "y.parts"))))


def joined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (``doc_id, text_hash, n, f``) and the component (``v, root``) of each set that links."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n long, f long, parts array<int>, slice int, counts binary"
    profile = stage(docs.mapInArrow(_profile, schema), "profile")
    rarity = rarity_table(profile)
    rows = profile.where("slice IS NULL").select("doc_id", "text_hash", "n", "f")
    classes = stage(
        profile.where("n > 0").groupBy("f").agg(
            F.first("n").alias("n"), F.first("parts").alias("parts"), F.min("text_hash").alias("text_hash")
        ),
        "classes",
    )
    schema = "h long, f long, n int, pos int"
    # Fixed in size, and used by two jobs: sent to the executors once, not with each plan.
    rarity = docs.sparkSession.sparkContext.broadcast(rarity)
    keys = docs.select("text").mapInArrow(_prefixes(rarity, None), schema)
    often = stage(keys.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    often = bitmap_array(often, "h", SHARED_BITS)
    often = docs.sparkSession.sparkContext.broadcast(often)
    shared = stage(docs.select("text").mapInArrow(_prefixes(rarity, often), schema).distinct(), "shared")
    rarity.unpersist()
    often.unpersist()
    alone, placed = _pairs_and_groups(shared)
    links = comps = sets = None
    for turn in range(len(HUBS) + 1):
        if comps is not None:
            placed = _still_apart(placed.drop("comp").join(comps.withColumnRenamed("v", "f"), "f", "left").select(
                "h", "f", "n", "pos", F.coalesce("root", "f").alias("comp")
            ))
        # Pairs that were tried and do not link are few by now, and may be looked at again.
        if turn == len(HUBS):
            near = _rest(_with_parts(placed, classes))
        else:
            near = _star(placed, turn)
            near = suffix_filtered(near.unionByName(alone).distinct() if turn == 0 else near, classes)
        near = stage(near, "near")
        wanted = near.select(F.col("a").alias("f")).union(near.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets, "f", "left_anti")
        wanted = stage(classes.select("f", "text_hash").join(wanted, "f", "left_semi"), "wanted")
        bitmap = bitmap_array(wanted, "text_hash", TEXT_BITS)
        if bitmap.any():
            more = docs.select("text_hash", "text").mapInArrow(_sets(bitmap), "f long, shingles array<long>")
            more = stage(more.join(wanted, "f", "left_semi").dropDuplicates(["f"]), "sets")
            sets = more if sets is None else sets.union(more)
        if sets is not None:
            found = stage(verified(near, sets), "links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                comps = stage(components(links), "components")
    if comps is None:
        comps = rows.where("false").select(F.col("f").alias("v"), F.col("f").alias("root"))
    return rows, comps


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: id, text hash, number of shingles, and the least id that links reach."""
    rows, comps = joined(documents)
    rows = rows.join(comps.withColumnRenamed("v", "f"), "f", "left").withColumn("comp", F.coalesce("root", "f"))
    names = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = rows.join(names, "comp", "left")
    return named.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("comp")).alias("component"),
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the row least in id, then text hash, stays once.

    Texts without words are in no component and all stay.
    """
    found = near_duplicates(documents).where("component IS NOT NULL")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = found.groupBy("component").agg(F.min(first).alias("k")).select(F.xxhash64("k.doc_id", "k.text_hash").alias("__row"))
    hashed = documents.withColumn("__row", F.xxhash64("doc_id", F.xxhash64("text")))
    some = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # One key for the join and for repeated rows: texts are shuffled once.
    stay = hashed.where(some).join(kept, "__row", "left_semi").dropDuplicates(["__row"])
    return stay.unionByName(hashed.where(~some)).select(*documents.columns)


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")
