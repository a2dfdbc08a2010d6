"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in the order of a seeded hash, cut into blocks of
equal words. A source's target is a quota of blocks, the last one cut to the word, or with ``whole`` to
the nearer end of the text there, so that no text is cut; beyond its size the stream is begun again. The vector of quotas is split down a binary tree of output shards: at
each node the left half's share of every source is drawn from the multivariate hypergeometric
distribution, so quotas stay exact and each shard looks like a random draw without replacement. A
shard takes the next of its sources' permuted blocks, and ``order_key`` shuffles its pieces locally.

Only DataFrame and Column operations. Positions in a hot source come from two-level sums over hash
buckets, so no source is ever one group. One vector of quotas is as long as there are sources.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of
its own and comes last; repeated rows are taken each; an empty table mixes to nothing. Other columns
are not read, so their names may clash with the output.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import space_words, table
from tally.llm.registry import query
from tally.session import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 1_000_000
BLOCKS_PER_SOURCE = 1_024
SHARD_WORDS = 10_000_000
ROWS_PER_BUCKET = 10_000
SEED = 42
# Coprime to any number of blocks that is not its multiple.
_STRIDE = 2_147_483_647
# Draws beyond so many standard deviations have a probability below 1e-30.
_TAIL = 12


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: number, size, rows and target words, capped and reshared by weight.

    The cap of a source is ``MAX_EPOCHS`` times its size. With sources in the order of cap over
    weight, the capped ones come first, and all others share what is left by weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("sid", number).withColumn("w", weight)
    cap = (MAX_EPOCHS * F.col("source_size")).cast("double")
    per = per.withColumn("cap", cap).withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    used = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - used) / left)
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))
    level = F.min(free).over(Window.partitionBy())["level"]
    per = per.withColumn("target", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")))
    return per.select("sid", "source", "source_size", "rows", "target")


def _draws(sources: DataFrame) -> DataFrame:
    """Block length, words and blocks of either epoch, and hash buckets of each source."""
    n, words = F.col("source_size"), F.round("target").cast("long")
    sources = sources.withColumn(
        "block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(n / BLOCKS_PER_SOURCE)))
    )
    sources = sources.withColumn("words0", F.least(n, words)).withColumn("words1", words - F.least(n, words))
    return _blocks(sources).withColumn("buckets", F.ceil(F.col("rows") / ROWS_PER_BUCKET))


def _blocks(sources: DataFrame) -> DataFrame:
    return (
        sources.withColumn("draws0", F.ceil(F.col("words0") / F.col("block")))
        .withColumn("draws1", F.ceil(F.col("words1") / F.col("block")))
    )


def _unit(*parts) -> Column:
    """A uniform number in [0, 1) that depends on its arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it in a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(total: Column, good: Column, taken: Column, u: Column) -> Column:
    """How many of ``taken`` items, out of ``total`` with ``good`` ones, are good: the draw that ``u`` picks.

    Outcomes are tried from the mode upwards, then downwards, each weighed by the ratio to its
    neighbour; any fixed order of outcomes makes ``u`` pick each with its own probability.
    """
    total, good, taken = total.cast("double"), good.cast("double"), taken.cast("double")
    low, high = F.greatest(F.lit(0.0), taken - (total - good)), F.least(good, taken)
    part = F.when(total > 0, good / total).otherwise(0.0)
    spread = F.sqrt(taken * part * (1 - part) * F.greatest(total - taken, F.lit(0.0)) / F.greatest(total - 1, F.lit(1.0)))
    reach = F.ceil(spread * _TAIL) + _TAIL
    mode = F.least(high, F.greatest(low, F.floor((good + 1) * (taken + 1) / (total + 2)).cast("double")))

    def start(x: Column, p: Column | float, cum: Column | float) -> Column:
        return F.struct(
            x.alias("x"), F.lit(p).cast("double").alias("p"), F.lit(cum).cast("double").alias("cum"),
            F.lit(None).cast("double").alias("pick"),
        )

    def walk(first: Column, up: bool, goal: Column) -> Column:
        steps = F.least((high - mode) if up else (mode - low), reach.cast("double")).cast("long")

        def step(a: Column, _: Column) -> Column:
            x = a["x"]
            ratio = (
                (good - x) * (taken - x) / ((x + 1) * (total - good - taken + x + 1))
                if up
                else x * (total - good - taken + x) / ((good - x + 1) * (taken - x + 1))
            )
            p = a["p"] * ratio
            to = x + 1 if up else x - 1
            return F.struct(
                to.alias("x"), p.alias("p"), (a["cum"] + p).alias("cum"),
                F.coalesce(a["pick"], F.when(a["cum"] + p >= goal, to)).alias("pick"),
            )

        none = F.array().cast("array<bigint>")
        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(none), first, step)

    never = F.lit(float("inf"))
    weight = walk(start(mode, 1.0, 1.0), True, never)["cum"] + walk(start(mode, 1.0, 0.0), False, never)["cum"]

    def pick(goal: Column) -> Column:
        def downwards(above: Column) -> Column:
            return F.coalesce(above["pick"], walk(start(mode, 1.0, above["cum"]), False, goal)["pick"], mode)

        return F.when(goal <= 1.0, mode).otherwise(_let(walk(start(mode, 1.0, 1.0), True, goal), downwards))

    return _let(u * weight, pick).cast("long")


def _left_quotas(quotas: Column, capacity: Column, lo: Column, hi: Column, seed: int) -> Column:
    """The left half's quota of every source, drawn source after source given what is left."""
    empty = F.array().cast("array<bigint>")
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.struct(whole.alias("left"), capacity.cast("long").alias("room"), empty.alias("out"))

    def draw(a: Column, x: Column) -> Column:
        return hypergeometric(a["left"], x, a["room"], _unit(F.lit(seed), lo, hi, F.size(a["out"])))

    def step(a: Column, x: Column) -> Column:
        def after(drawn: Column) -> Column:
            return F.struct(
                (a["left"] - x).alias("left"), (a["room"] - drawn).alias("room"),
                F.concat(a["out"], F.array(drawn)).alias("out"),
            )

        return _let(draw(a, x), after)

    return F.aggregate(quotas, first, step, lambda a: a["out"])


def split_quotas(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (``shard, sid, first, draws``): which of its source's permuted draws a shard takes."""
    listed = F.array_sort(F.collect_list(F.struct("sid", (F.col("draws0") + F.col("draws1")).alias("n"))))
    root = sources.groupBy().agg(listed.alias("all"))
    nodes = root.select(
        F.lit(0).cast("long").alias("lo"),
        F.lit(shards).cast("long").alias("hi"),
        F.transform("all", lambda x: x["n"]).alias("quotas"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("blocks"),
    )
    edge = lambda i: F.floor(i * F.col("blocks") / shards)
    for depth in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        nodes = nodes.withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, mid))
        drawn = F.when(
            F.col("mid").isNotNull(),
            _left_quotas(F.col("quotas"), edge(F.col("mid")) - edge(F.col("lo")), F.col("lo"), F.col("hi"), seed),
        )
        nodes = nodes.select("*", F.explode(F.array(drawn)).alias("left"))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        node = lambda lo, hi, q: F.struct(lo.alias("lo"), hi.alias("hi"), q.alias("quotas"))
        halves = F.when(
            F.col("mid").isNotNull(),
            F.array(node(F.col("lo"), F.col("mid"), F.col("left")), node(F.col("mid"), F.col("hi"), right)),
        ).otherwise(F.array(node(F.col("lo"), F.col("hi"), F.col("quotas"))))
        nodes = nodes.select("blocks", F.inline(halves))
        if depth == 8:
            nodes = nodes.repartition("lo")
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("quotas").alias("sid", "draws"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("draws").over(before), F.lit(0))
    return leaves.select("shard", "sid", first.alias("first"), "draws")


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Every document with its place in its source's stream of words, and a number that tells its row."""
    rows = sized.withColumnRenamed("source", "__s").join(sources, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    share = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("bucket", F.floor(share * F.col("buckets")))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size")
    earlier = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(earlier, F.lit(0)))
    rows = rows.withColumn("row", F.row_number().over(in_bucket)).join(sums, ["sid", "bucket"])
    return rows.withColumn("begin", F.col("before") + F.col("within"))


def _to_whole_texts(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with quotas that end where a text does: with the one at the border if that is nearer, else before it."""
    quota = F.when(F.col("words1") > 0, F.col("words1")).otherwise(F.col("words0"))
    end = F.col("begin") + F.col("size")
    border = placed.where((F.col("begin") < quota) & (quota < end))
    border = border.select("sid", F.when(quota - F.col("begin") >= end - quota, end).otherwise(F.col("begin")).alias("ends"))
    second = F.col("words1") > 0
    sources = sources.join(border, "sid", "left").withColumns({
        "words0": F.when(second, F.col("words0")).otherwise(F.coalesce("ends", "words0")),
        "words1": F.when(second, F.coalesce("ends", "words1")).otherwise(F.col("words1")),
    })
    return _blocks(sources.drop("ends", "draws0", "draws1"))


def _pieces(placed: DataFrame) -> DataFrame:
    """A row for each block that a document reaches into in either epoch, and at least one for each document."""

    def epoch(e: int) -> Column:
        words, draws, block = F.col(f"words{e}"), F.col(f"draws{e}"), F.col("block")
        begin, end = F.col("begin"), F.least(F.col("begin") + F.col("size"), words)
        blocks = F.when(
            end > begin, F.sequence(F.floor(begin / block), F.floor((end - 1) / block))
        ).otherwise(F.array().cast("array<bigint>"))

        def piece(b: Column) -> Column:
            turned = F.pmod(b * _STRIDE + F.xxhash64(F.lit(SEED + e), "sid") % 1_000_003, draws)
            start = F.greatest(begin, b * block)
            return F.struct(
                F.lit(e).alias("epoch"),
                b.alias("at_block"),
                (turned + (F.col("draws0") if e else 0)).alias("draw"),
                (start - begin).alias("word_from"),
                (F.least(end, (b + 1) * block) - start).alias("words"),
            )

        return F.transform(blocks, piece)

    return placed.select("*", F.inline_outer(F.concat(epoch(0), epoch(1))))


def mix(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, seed: int = SEED,
    shard_words: int = SHARD_WORDS, whole: bool = False,
) -> DataFrame:
    """The pieces of the mix: document, source, target, shard, draw, words from where and how many, local order.

    A document that is not taken has one row without a shard and with 0 words. With ``whole``, a source's
    quota ends with a text.
    """
    sized = stage(
        documents.select(
            "doc_id", "source", F.coalesce(F.size(space_words(F.col("text"))), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ).withColumn("size", F.greatest("size", F.lit(0))),
        "sized",
    )
    sources = stage(_draws(source_targets(sized, weights, share)), "sources")
    placed = _placed(sized, sources, seed)
    if whole:
        placed = stage(placed, "placed")
        sources = stage(_to_whole_texts(placed, sources), "whole")
        quota = ["words0", "words1", "draws0", "draws1"]
        placed = placed.drop(*quota).join(sources.select("sid", *quota), "sid")
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(words / shard_words))
    quotas = split_quotas(sources, shards, seed)
    drawn = quotas.where("draws > 0").select(
        "shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("draw")
    )
    pieces = _pieces(placed).join(drawn, ["sid", "draw"], "left")
    return pieces.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", "sid", "bucket", "row", "shard", "epoch", "draw",
        "word_from", F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0).alias("words"),
        F.xxhash64(F.lit(seed), "shard", "draw", "begin", "doc_id").alias("order_key"),
    )


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    by_row = ["sid", "bucket", "row", "doc_id", "source", "size", "text_hash", "source_size", "target"]
    return mix(documents, **options).groupBy(*by_row).agg(F.sum("words").alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each epoch in which a text is taken.

    A document taken twice has two rows. Without ``whole`` the last text of a source may be cut after some of
    its words; ``n_chars`` is its length then. Columns and their order are those of ``documents``.
    """
    pieces = mix(documents, **options).where("words > 0").withColumn("__row", F.xxhash64("doc_id", "text_hash"))
    epochs = pieces.groupBy("sid", "bucket", "row", "__row", "size", "epoch").agg(F.sum("words").alias("k"))
    takes = epochs.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("epoch", "k", "size"))).alias("__takes"))
    # One key for repeated rows and for the join: texts are shuffled once.
    texts = documents.withColumn("__row", F.xxhash64("doc_id", F.xxhash64("text"))).dropDuplicates(["__row"])
    joined = texts.join(takes, "__row").select(*documents.columns, F.explode("__takes").alias("__t"))
    begin = F.slice(
        F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__t")["k"].cast("int")
    )
    text = F.when(F.col("__t")["k"] >= F.col("__t")["size"], F.col("text")).otherwise(F.array_join(begin, ""))
    out = {"text": text}
    if "n_chars" in documents.columns:
        whole = F.col("__t")["k"] >= F.col("__t")["size"]
        out["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return joined.withColumns(out).select(*documents.columns)


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    taken = taken_words(table(spark, sf_dir, "documents"), whole=True)
    return taken.select("doc_id", "size", "source_size", "target", "taken")
