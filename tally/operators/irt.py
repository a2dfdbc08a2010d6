"""Two-parameter logistic item response fits on response patterns.

Persons collapse to answer patterns and their counts in one aggregation, so a
fit never sees persons. The caller picks the form: ``grouped`` fits each group in
one task, all groups in parallel, which suits some dozen items (k items make at
most ``2**k`` patterns a group); ``summed`` keeps the parameters in a written table,
joins them to the patterns each round, has Spark add up the expected counts of 41
nodes, and updates each item from those; nothing passes through the driver but
whether a group still moves. Both give the same fit, rounds and verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally import fixed
from tally.operators.reshape import item_columns
from tally.operators.rows import first_per_key
from tally.session import stage

NODES = np.linspace(-6.0, 6.0, 41)
PRIOR = np.exp(-0.5 * NODES**2) / np.exp(-0.5 * NODES**2).sum()
SLOPE_BOUNDS = (0.05, 5.0)
DIFFICULTY_BOUNDS = (-6.0, 6.0)
MAX_ROUNDS = 500
STEPS = 5
TOLERANCE = 1e-6


def pattern_of(items: Sequence[str]) -> Column:
    """The answers of a row as text: 1 where right, 0 for anything else.

    Only two characters occur, so k items give at most ``2**k`` patterns.
    """
    return F.concat(*[F.when(F.col(c) == 1, F.lit("1")).otherwise(F.lit("0")) for c in items])


def domain_answers(df: DataFrame, id_column: str) -> DataFrame:
    """Every student's pattern in every domain of a feed, from one deduplication."""
    one_each = first_per_key(df, id_column)
    parts = [
        F.struct(F.lit(d).alias("domain"), pattern_of(columns).alias("pattern"))
        for d in fixed.ITEM_BLOCKS
        if (columns := item_columns(df, d))
    ]
    return one_each.select(id_column, F.inline(F.array(*parts)))


def response_patterns(answers: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """How many persons gave each pattern."""
    return answers.groupBy(*segments, "pattern").agg(F.count("*").alias("n"))


# --- numeric helpers (arrays of at most items x nodes x patterns) --------------


def _as_marks(patterns: Iterable[str]) -> np.ndarray:
    return np.array([[int(ch) for ch in p] for p in patterns], dtype=float)


def _chances(slope: np.ndarray, difficulty: np.ndarray) -> np.ndarray:
    """Chance of a right answer, items x nodes, kept off 0 and 1."""
    z = slope[:, None] * (NODES[None, :] - difficulty[:, None])
    return np.clip(1.0 / (1.0 + np.exp(-z)), 1e-12, 1 - 1e-12)


def _posterior(marks: np.ndarray, slope: np.ndarray, difficulty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every node for every pattern, and the pattern's log likelihood."""
    p = _chances(slope, difficulty)
    joint = marks @ np.log(p) + (1 - marks) @ np.log1p(-p) + np.log(PRIOR)
    top = joint.max(axis=1, keepdims=True)
    weight = np.exp(joint - top)
    total = weight.sum(axis=1, keepdims=True)
    return weight / total, (top + np.log(total))[:, 0]


def _expected(marks, counts, slope, difficulty) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected right answers (items x nodes), expected persons (nodes), log likelihood."""
    weight, loglik = _posterior(marks, slope, difficulty)
    weighted = weight * counts[:, None]
    return marks.T @ weighted, weighted.sum(axis=0), float(counts @ loglik)


def _update(right, persons, slope, difficulty) -> tuple[np.ndarray, np.ndarray]:
    """Scoring steps on the expected counts, all items at once, in slope-intercept form."""
    a, d = slope.copy(), -slope * difficulty
    for _ in range(STEPS):
        p = np.clip(1.0 / (1.0 + np.exp(-(a[:, None] * NODES + d[:, None]))), 1e-12, 1 - 1e-12)
        gap, info = right - persons * p, persons * p * (1 - p)
        grad_a, grad_d = gap @ NODES, gap.sum(axis=1)
        aa, ad, dd = info @ NODES**2 + 1e-9, info @ NODES, info.sum(axis=1) + 1e-9
        det = aa * dd - ad * ad
        move_a = np.clip((dd * grad_a - ad * grad_d) / det, -0.5, 0.5)
        move_d = np.clip((aa * grad_d - ad * grad_a) / det, -0.5, 0.5)
        a, d = np.clip(a + move_a, *SLOPE_BOUNDS), d + move_d
        if max(np.abs(move_a).max(), np.abs(move_d).max()) < 1e-8:
            break
    return a, np.clip(-d / a, *DIFFICULTY_BOUNDS)


def _start(share_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = np.clip(share_right, 0.01, 0.99)
    return np.ones(len(share)), -np.log(share / (1 - share))


def _settled(old, new) -> bool:
    return max(np.abs(old[0] - new[0]).max(), np.abs(old[1] - new[1]).max()) < TOLERANCE


def _fit_group(patterns: Sequence[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, bool]:
    marks = _as_marks(patterns)
    params = _start(counts @ marks / counts.sum())
    for rounds in range(1, MAX_ROUNDS + 1):  # noqa: B007
        right, persons, _loglik = _expected(marks, counts, *params)
        new = _update(right, persons, *params)
        done = _settled(params, new)
        params = new
        if done:
            break
    return *params, _expected(marks, counts, *params)[2], rounds, done


# --- Spark side ---------------------------------------------------------------


def _fit_schema(patterns: DataFrame, segments: Sequence[str]) -> T.StructType:
    arrays = T.ArrayType(T.DoubleType())
    return T.StructType(
        [patterns.schema[s] for s in segments]
        + [
            T.StructField("slope", arrays),
            T.StructField("difficulty", arrays),
            T.StructField("loglik", T.DoubleType()),
            T.StructField("n_persons", T.LongType()),
            T.StructField("rounds", T.IntegerType()),
            T.StructField("converged", T.BooleanType()),
        ]
    )


def fit_groups(patterns: DataFrame, segments: Sequence[str] = (), form: str = "grouped") -> DataFrame:
    """One row per group: slopes, difficulties, log likelihood, persons, rounds and whether the fit settled.

    ``form`` is ``grouped`` or ``summed``, see above.
    """
    if form == "summed":
        return stage(_fit_wide(stage(patterns, "patterns"), segments), "fits")
    names = list(segments)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("pattern")
        counts = ordered["n"].to_numpy(dtype=float)
        slope, difficulty, loglik, rounds, done = _fit_group(ordered["pattern"].tolist(), counts)
        row = {s: ordered[s].iloc[0] for s in names}
        row |= {"slope": slope, "difficulty": difficulty, "loglik": loglik, "n_persons": int(counts.sum())}
        row |= {"rounds": rounds, "converged": done}
        return pd.DataFrame([row])

    return stage(patterns.groupBy(*names).applyInPandas(fit, _fit_schema(patterns, names)), "fits")


# --- the summed form: state in a table, one plan a round -------------------------


def _numbers(values: Iterable[float]) -> Column:
    """Known numbers as one constant array; a text keeps the plan small where each would be an expression of its own."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def quadrature(slope: Column, difficulty: Column) -> tuple[Column, Column]:
    """Per node: what each right answer adds to the log weight, and the log weight of no right answer.

    ``slope`` and ``difficulty`` are arrays over the items of a group.
    """
    items = F.arrays_zip(slope.alias("a"), difficulty.alias("b"))

    def chance(x: Column):
        def of(i: Column) -> Column:
            p = 1 / (1 + F.exp(-i["a"] * (x - i["b"])))
            return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))

        return of

    nodes = F.arrays_zip(_numbers(NODES).alias("x"), _numbers(np.log(PRIOR)).alias("w"))
    added = F.transform(nodes, lambda v: F.transform(items, lambda i: F.log(chance(v["x"])(i)) - F.log(1 - chance(v["x"])(i))))
    none = F.transform(nodes, lambda v: F.aggregate(items, v["w"], lambda t, i: t + F.log(1 - chance(v["x"])(i))))
    return added, none


def node_weights(marks: Column, added: Column, none: Column) -> Column:
    """The log weight of every node for a pattern's marks."""
    return F.zip_with(
        added, none,
        lambda row, base: base + F.aggregate(F.zip_with(row, marks, lambda d, m: d * m), F.lit(0.0), lambda t, x: t + x),
    )


def log_sum(logs: Column) -> Column:
    """Log of the sum of exponentials, taken from the greatest so that nothing runs over."""
    top = F.array_max(logs)
    return top + F.log(F.aggregate(F.transform(logs, lambda x: F.exp(x - top)), F.lit(0.0), lambda t, x: t + x))


def _marked(patterns: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Patterns with their group under one key and their marks as numbers."""
    key = F.to_json(F.struct(*segments)) if segments else F.lit("{}")
    marks = F.transform(F.sequence(F.lit(1), F.length("pattern")), lambda i: F.substr("pattern", i, F.lit(1)).cast("double"))
    return patterns.select(*segments, key.alias("__key"), "pattern", marks.alias("marks"), F.col("n").cast("double").alias("n"))


def _width(marked: DataFrame) -> int:
    """The most items a group has."""
    return marked.select(F.max(F.size("marks"))).first()[0] or 0


def start_values(marked: DataFrame) -> DataFrame:
    """One row per group: slope 1 and the difficulty that the share of right answers suggests."""
    shares = marked.select("__key", "n", F.posexplode("marks").alias("item", "mark")).groupBy("__key", "item").agg(
        (F.sum(F.col("mark") * F.col("n")) / F.sum("n")).alias("share")
    )
    share = F.least(F.greatest(F.col("share"), F.lit(0.01)), F.lit(0.99))
    per_item = F.array_sort(F.collect_list(F.struct("item", (-F.log(share / (1 - share))).alias("b"))))
    starts = shares.groupBy("__key").agg(per_item.alias("items"))
    return starts.select(
        "__key", F.transform("items", lambda i: F.lit(1.0)).alias("slope"), F.transform("items", lambda i: i["b"]).alias("difficulty"),
        F.lit(0).alias("rounds"), F.lit(False).alias("converged"),
    )


def expected_counts(width: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of marked patterns and a state: ``(__key, node, persons, right, loglik)``, at most 41 rows a group.

    ``persons`` are expected at the node, ``right`` are their expected right answers to each of ``width``
    items, and the log likelihood stands on node 0; Spark sums them over all patterns. The expressions are
    put together once and serve every round.
    """
    added, none = quadrature(F.col("slope"), F.col("difficulty"))
    known = ["__key", added.alias("added"), none.alias("none")]
    logs = node_weights(F.col("marks"), F.col("added"), F.col("none")).alias("logs")
    total = log_sum(F.col("logs"))
    post = F.posexplode(F.transform("logs", lambda x: F.exp(x - F.col("total")))).alias("node", "weight")
    weighted = F.col("weight") * F.col("n")
    sums = [
        F.sum(weighted).alias("persons"), F.array(*[F.sum(weighted * F.get("marks", F.lit(i))) for i in range(width)]).alias("right"),
        F.sum(F.when(F.col("node") == 0, F.col("n") * F.col("total"))).alias("loglik"),
    ]

    def counted(marked: DataFrame, state: DataFrame) -> DataFrame:
        rows = marked.join(state.select(*known), "__key").select("__key", "n", "marks", logs).withColumn("total", total)
        return rows.select("__key", "n", "marks", "total", post).groupBy("__key", "node").agg(*sums)

    return counted


def _newton(persons: Column, right: Column, slope: Column, difficulty: Column) -> Column:
    """Scoring steps for one item on its expected counts over the nodes; a struct of the new slope and intercept."""
    table = F.arrays_zip(_numbers(NODES).alias("x"), persons.alias("n"), right.alias("r"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("ga", "gd", "aa", "ad", "dd")])

    def sums(s: Column) -> Column:
        def add(t: Column, v: Column) -> Column:
            p = 1 / (1 + F.exp(-(s["a"] * v["x"] + s["d"])))
            p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
            gap, info = v["r"] - v["n"] * p, v["n"] * p * (1 - p)
            return F.struct(
                (t["ga"] + gap * v["x"]).alias("ga"), (t["gd"] + gap).alias("gd"), (t["aa"] + info * v["x"] * v["x"]).alias("aa"),
                (t["ad"] + info * v["x"]).alias("ad"), (t["dd"] + info).alias("dd"),
            )

        return F.aggregate(table, zero, add)

    def moved(s: Column, t: Column) -> Column:
        aa, dd = t["aa"] + 1e-9, t["dd"] + 1e-9
        det = aa * dd - t["ad"] * t["ad"]

        def within(x: Column, low: float, high: float) -> Column:
            return F.least(F.greatest(x, F.lit(low)), F.lit(high))

        a = s["a"] + within((dd * t["ga"] - t["ad"] * t["gd"]) / det, -0.5, 0.5)
        return F.struct(
            within(a, *SLOPE_BOUNDS).alias("a"), (s["d"] + within((aa * t["gd"] - t["ad"] * t["ga"]) / det, -0.5, 0.5)).alias("d")
        )

    def step(s: Column, _: Column) -> Column:
        # A one-element array binds the sums, so that they are worked out once a step.
        return F.element_at(F.transform(F.array(sums(s)), lambda t: moved(s, t)), 1)

    start = F.struct(slope.alias("a"), (-slope * difficulty).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def one_round(width: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of marked patterns and a state: the state after expected counts and a Newton update for each (group, item)."""
    counted = expected_counts(width)
    tables = F.array_sort(F.collect_list(F.struct("node", "persons", "right"))).alias("t")
    items = F.posexplode(F.arrays_zip(F.col("slope").alias("a"), F.col("difficulty").alias("b"))).alias("item", "old")
    persons = F.transform("t", lambda v: v["persons"])
    right = F.transform("t", lambda v: F.get(v["right"], F.col("item")))
    new = _newton(persons, right, F.col("old.a"), F.col("old.b"))
    low, high = DIFFICULTY_BOUNDS
    b = F.least(F.greatest(-F.col("new.d") / F.col("new.a"), F.lit(low)), F.lit(high))
    updated = ["__key", "item", "old", F.col("new.a").alias("a"), b.alias("b"), "rounds", "converged"]
    gap = F.greatest(F.abs(F.col("a") - F.col("old.a")), F.abs(F.col("b") - F.col("old.b")))
    # A group that has settled keeps its values while others go on.
    kept = [F.when(F.col("converged"), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in ("a", "b")]
    together = [F.array_sort(F.collect_list(F.struct("item", *kept))).alias("items"), (F.max(gap) < TOLERANCE).alias("settled")]
    state_columns = [
        "__key", F.transform("items", lambda i: i["a"]).alias("slope"), F.transform("items", lambda i: i["b"]).alias("difficulty"),
        (F.col("rounds") + (~F.col("converged")).cast("int")).alias("rounds"), (F.col("converged") | F.col("settled")).alias("converged"),
    ]

    def next_state(marked: DataFrame, state: DataFrame) -> DataFrame:
        nodes = counted(marked, state).groupBy("__key").agg(tables)
        each = state.join(nodes, "__key").select("*", items).withColumn("new", new).select(*updated)
        return each.groupBy("__key", "rounds", "converged").agg(*together).select(*state_columns)

    return next_state


def _fit_wide(patterns: DataFrame, segments: Sequence[str]) -> DataFrame:
    """The same fit when patterns are too many for one task.

    The state is one row per group in a written table that meets the patterns each round; the driver
    learns one row a round, whether any group still moves.
    """
    names = list(segments)
    marked = stage(_marked(patterns, names), "marked")
    width = _width(marked)
    state = stage(start_values(marked), "state")
    next_state = one_round(width)
    for _ in range(MAX_ROUNDS):
        state = stage(next_state(marked, state), "state")
        if state.select(F.every("converged")).first()[0] is not False:
            break
    loglik = expected_counts(width)(marked, state).groupBy("__key").agg(F.sum("loglik").alias("loglik"))
    groups = marked.groupBy(*names, "__key").agg(F.sum("n").cast("long").alias("n_persons"))
    columns = [*names, "slope", "difficulty", "loglik", "n_persons", "rounds", "converged"]
    return groups.join(state, "__key").join(loglik, "__key").select(*columns)


def expectation_step(patterns: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """One expectation step at the starting values: per group, item and node expected persons and right answers."""
    marked = stage(_marked(patterns, list(segments)), "marked")
    sums = expected_counts(_width(marked))(marked, start_values(marked))
    keys = marked.select(*segments, "__key").distinct()
    return keys.join(sums, "__key").select(
        *segments, "node", F.round("persons", 6).alias("persons"), F.posexplode("right").alias("item", "right")
    ).withColumn("right", F.round("right", 6))


def item_parameters(fits: DataFrame, items: Sequence[str] | Column, segments: Sequence[str] = ()) -> DataFrame:
    """One row per item: difficulty and discrimination, three decimals.

    ``items`` names the items in pattern order, as a list or an array column.
    """
    labels = items if isinstance(items, Column) else F.array(*[F.lit(c) for c in items])
    zipped = F.arrays_zip(labels.alias("item"), F.col("difficulty"), F.col("slope"))
    return fits.select(*segments, F.explode(zipped).alias("p")).select(
        *segments,
        F.col("p.item").alias("item"),
        F.round("p.difficulty", 3).alias("difficulty"),
        F.round("p.slope", 3).alias("discrimination"),
    )


def fit_statistics(fits: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """Persons, AIC and BIC per group."""
    k = 2 * F.size("slope")
    return fits.select(
        *segments,
        "n_persons",
        F.round(2 * k - 2 * F.col("loglik"), 1).alias("aic"),
        F.round(k * F.log("n_persons") - 2 * F.col("loglik"), 1).alias("bic"),
    )


def expected_ability(pattern: Column, slope: Column, difficulty: Column) -> Column:
    """Mean of the ability nodes, weighed by how likely each makes the pattern."""
    marks = F.filter(F.split(pattern, ""), lambda m: m != "")
    items = F.arrays_zip(marks.alias("mark"), slope.alias("slope"), difficulty.alias("difficulty"))

    def log_weight(node: float, prior: float) -> Column:
        def add(total: Column, item: Column) -> Column:
            p = 1 / (1 + F.exp(-item["slope"] * (F.lit(node) - item["difficulty"])))
            p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
            return total + F.when(item["mark"] == "1", F.log(p)).otherwise(F.log(1 - p))

        return F.aggregate(items, F.lit(float(np.log(prior))), add)

    logs = F.array(*[log_weight(float(x), float(w)) for x, w in zip(NODES, PRIOR)])

    def mean(lw: Column) -> Column:
        weights = F.transform(lw, lambda x: F.exp(x - F.array_max(lw)))
        nodes = F.array(*[F.lit(float(x)) for x in NODES])
        sums = [F.aggregate(v, F.lit(0.0), lambda t, x: t + x) for v in (F.zip_with(weights, nodes, lambda w, x: w * x), weights)]
        return sums[0] / sums[1]

    return F.element_at(F.transform(F.array(logs), mean), 1)


def pattern_abilities(patterns: DataFrame, fits: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """Expected ability of every pattern under its group's fit.

    Written out, so Catalyst knows how small it is when persons join it.
    """
    names = list(segments)
    known = patterns.select(*names, "pattern", "n")
    if names:
        joined = known.join(fits.select(*names, "slope", "difficulty"), names)
    else:
        fit = fits.select(F.struct("slope", "difficulty")).scalar()
        joined = known.withColumns({"slope": fit["slope"], "difficulty": fit["difficulty"]})
    ability = expected_ability(F.col("pattern"), F.col("slope"), F.col("difficulty"))
    return stage(joined.select(*names, "pattern", "n", ability.alias("ability")), "abilities")


def person_abilities(
    answers: DataFrame, abilities: DataFrame, id_column: str, segments: Sequence[str] = ()
) -> DataFrame:
    """Every person's ability, by joining patterns back to persons."""
    lookup = abilities.select(*segments, "pattern", "ability")
    return answers.join(lookup, [*segments, "pattern"]).select(id_column, *segments, "ability")
