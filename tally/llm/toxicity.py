"""Toxicity with a linear-chain conditional random field over words.

Documents carry labels, words do not, so words are labelled first: features of words (the word, and
its first letters) that stand in toxic documents far more often than elsewhere, each counted once for
every word that stands before it so that copies count little. The two-state chain is fitted by
gradient ascent on whole labelled documents, forward-backward gives each word's marginal, and a
logistic curve over the log of their sum gives the document's score. Words with a marginal of a half
or more are the offending spans, given as offsets in code points.

A chain runs over a whole text and is never cut. Words without a known feature all weigh the same, so messages
cross a stretch of them by a power of one matrix, and its marginals and moves add up in closed form; work and memory
beyond the reading of a text go with its words that have known features.

Fitting uses at most ``limit`` labelled rows of either label, by the order of a hash, in one task; all features that
are clear enough there are kept. Scoring uses texts alone, each in its own task. Defined results: null and empty texts
have no words and the least score; labels that are null or contradict each other are not used; without toxic labels
nothing is toxic; repeated rows are scored alike; very long texts are scored whole; rows of equal hash are taken in the
order of their ids; an empty table gives an empty table. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import table
from tally.llm.registry import query
from tally.session import stage

FOLDS = 5
MAX_LABELLED = 3_000
PREFIXES = (4, 5, 6)
MIN_GAIN = 12.0
ROUNDS = 80
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(word: str) -> list[str]:
    """The word without marks at its ends, and its first letters where it has more."""
    bare = word.strip(_EDGES).lower()
    return [bare, *[f"{bare[:k]}-" for k in PREFIXES if len(bare) > k]] if bare else []


class Known(dict):
    """Word -> the numbers of its features that the model knows; kept for words seen lately."""

    def __init__(self, numbers: dict[str, int], limit: int = 400_000):
        super().__init__()
        self.numbers, self.limit = numbers, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = tuple(self.numbers[f] for f in features(word) if f in self.numbers)
        return value


def telling_features(texts: list[list[str]], toxic: list[bool]) -> list[str]:
    """Features whose share of toxic documents is too high for chance, the clearest first.

    Each pair of a feature and the word before it counts once for either label.
    """
    contexts: tuple[dict[str, set[int]], dict[str, set[int]]] = (defaultdict(set), defaultdict(set))
    cache: dict[str, list[str]] = {}

    def of(word: str) -> list[str]:
        found = cache.get(word)
        if found is None:
            found = cache[word] = features(word)
        return found

    for words, bad in zip(texts, toxic):
        if bad:
            for before, word in zip(["", *words], words):
                for f in of(word):
                    contexts[1][f].add(hash(before))
    often = {f for f, seen in contexts[1].items() if len(seen) >= 4}
    for words, bad in zip(texts, toxic):
        if not bad:
            for before, word in zip(["", *words], words):
                for f in of(word):
                    if f in often:
                        contexts[0][f].add(hash(before))
    totals = [sum(len(w) for w, t in zip(texts, toxic) if t == bad) for bad in (False, True)]
    rate = totals[1] / max(sum(totals), 1)
    gains = {}
    for f in often:
        t, n = len(contexts[1][f]), len(contexts[0].get(f, ()))
        if t > rate * (t + n) and t >= 4 * n:
            gains[f] = t * np.log(t / (t + n) / rate) + (n * np.log(n / (t + n) / (1 - rate)) if n else 0.0)
    return sorted((f for f in gains if gains[f] >= MIN_GAIN), key=lambda f: (-gains[f], f))


class Anchors:
    """The first word and the words with known features of some texts, and how many plain words follow each.

    Flat arrays in the order (number within the text, text with the most anchors first): those that are number j
    of their text lie side by side, and their successors begin the next block in the same order.
    """

    def __init__(self, texts: list[tuple[int, list[int], list[tuple[int, ...]]]]):
        """Of each text with words: the number of words, the places of its anchors, and the features of each."""
        count = np.array([len(at) for _, at, _ in texts], np.int64)
        order = np.argsort(-count, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        text = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(number))]).astype(np.int64)
        self.place = self.bounds[number] + rank[text]
        at = np.array([i for _, places, _ in texts for i in places], np.int64)
        after = np.array([i for n, places, _ in texts for i in [*places[1:], n]], np.int64)
        self.text, self.gap = np.empty_like(text), np.empty_like(at)
        self.text[self.place], self.gap[self.place] = text, after - at - 1
        pairs = [(i, k) for i, known in enumerate(f for _, _, parts in texts for f in parts) for k in known]
        where = np.array(pairs, np.int64).reshape(-1, 2)
        self.where, self.feature = self.place[where[:, 0]], where[:, 1]
        # The anchor that follows each, -1 after a text's last.
        self.next = np.full(len(at), -1, np.int64)
        for j in range(len(self.bounds) - 2):
            size = self.bounds[j + 2] - self.bounds[j + 1]
            self.next[self.bounds[j] : self.bounds[j] + size] = np.arange(size) + self.bounds[j + 1]

    def blocks(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]

    def emission(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.where, weights=weights[self.feature], minlength=len(self.text))


def _shares(messages: np.ndarray) -> np.ndarray:
    return messages / messages.sum(1, keepdims=True)


class Messages:
    """Forward and backward messages at anchors, and what marginals and moves add up to.

    With M the move into a plain word, M^k is proportional to ``main + ratio**k * rest`` (``main`` and ``rest``
    project on the two eigenvectors), so sums over the k words of a stretch are geometric.
    """

    def __init__(self, anchors: Anchors, emission: np.ndarray, bias: float, trans: np.ndarray):
        move = np.exp(trans)
        plain = move * np.array([1.0, np.exp(np.clip(bias, -30, 30))])
        middle = (plain[0, 0] + plain[1, 1]) / 2
        half = np.sqrt(((plain[0, 0] - plain[1, 1]) / 2) ** 2 + plain[0, 1] * plain[1, 0])
        self.top, self.ratio = middle + half, (middle - half) / (middle + half)
        main = (plain - (middle - half) * np.eye(2)) / (2 * half)
        rest = np.eye(2) - main
        obs = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=1)
        k, blocks = anchors.gap, anchors.blocks()
        far = self.ratio**k
        ahead, leaving = np.empty_like(obs), np.empty_like(obs)
        arriving, behind = np.ones_like(obs), np.empty_like(obs)
        for j, own in enumerate(blocks):
            if j:
                before = slice(blocks[j - 1].start, blocks[j - 1].start + own.stop - own.start)
                ahead[own] = _shares((leaving[before] @ move) * obs[own])
            else:
                ahead[own] = _shares(obs[own])
            leaving[own] = ahead[own] @ main + far[own, None] * (ahead[own] @ rest)
        for j in range(len(blocks) - 1, -1, -1):
            own = blocks[j]
            if j + 1 < len(blocks):
                after = blocks[j + 1]
                before = slice(own.start, own.start + after.stop - after.start)
                arriving[before] = _shares((obs[after] * behind[after]) @ move.T)
            behind[own] = _shares(arriving[own] @ main.T + far[own, None] * (arriving[own] @ rest.T))
        both = ahead * behind
        self.marginal = both[:, 1] / both.sum(1)
        self.total = (leaving * arriving).sum(1)
        self.from_main, self.from_rest = ahead @ main, ahead @ rest
        self.to_main, self.to_rest = arriving @ main.T, arriving @ rest.T
        x, y, z, w = (m[:, 1] for m in (self.from_main, self.from_rest, self.to_main, self.to_rest))
        near = (1 - far) / (1 - self.ratio)
        # Of the plain words after each anchor.
        self.stretch = np.maximum((k * x * z + x * w * near + y * z * self.ratio * near + k * far * y * w) / self.total, 0.0)
        self.gap, self.move, self.plain = k, move, plain
        self.leaving, self.arrives = leaving, obs * behind
        self.near, self.next = near, anchors.next

    def pairs(self) -> np.ndarray:
        """Expected moves between neighbouring words (2 x 2), over all texts."""
        k, one_less = self.gap, self.ratio ** np.maximum(self.gap - 1, 0)
        scale = 1 / (self.top * self.total)
        x, y, z, w = self.from_main, self.from_rest, self.to_main, self.to_rest
        inside = (
            (x * (k * scale)[:, None]).T @ z
            + (x * (self.near * scale)[:, None]).T @ w
            + (y * (self.near * scale)[:, None]).T @ z
            + (y * (k * one_less * scale)[:, None]).T @ w
        ) * self.plain
        joined = np.flatnonzero(self.next >= 0)
        steps = self.leaving[joined][:, :, None] * self.move * self.arrives[self.next[joined]][:, None, :]
        return inside + (steps / steps.sum((1, 2), keepdims=True)).sum(0)

    def of_text(self, rows: np.ndarray) -> np.ndarray:
        """The marginals of all words of the text with these anchors, in order."""
        k = self.gap[rows]
        first = np.cumsum(k + 1) - (k + 1)
        out = np.empty(int((k + 1).sum()))
        own = np.repeat(np.arange(len(rows)), k)
        t = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k) + 1
        r = rows[own]
        ahead = self.from_main[r, 1] + self.ratio**t * self.from_rest[r, 1]
        behind = self.to_main[r, 1] + self.ratio ** (k[own] - t) * self.to_rest[r, 1]
        out[first[own] + t] = ahead * behind / self.total[r]
        out[first] = self.marginal[rows]
        return out


def forward_backward(emission: np.ndarray, trans: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 (texts x words) and expected moves (2 x 2), for texts side by side.

    ``emission`` is the log weight of state 1 over state 0; words beyond a text's length are left out.
    """
    anchors = Anchors([(int(n), list(range(n)), [()] * int(n)) for n in length])
    inside = np.arange(emission.shape[1])[None, :] < length[:, None]
    flat = np.empty(len(anchors.place))
    flat[anchors.place] = emission[inside]
    found = Messages(anchors, flat, 0.0, trans)
    p = np.zeros(emission.shape)
    p[inside] = found.marginal[anchors.place]
    return p, found.pairs()


def anchored(words: list[str], known: Known) -> tuple[int, list[int], list[tuple[int, ...]]]:
    """Number of words, places of the first and of all with known features, and the features there."""
    found = [(i, f) for i, f in enumerate(map(known.__getitem__, words)) if f or not i]
    return len(words), [i for i, _ in found], [f for _, f in found]


class Chain:
    """The fitted chain and the curve from marginals to scores."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, trans: np.ndarray, curve: tuple[float, float]):
        self.names, self.weights, self.bias, self.trans, self.curve = names, weights, bias, trans, curve
        self.numbers = {f: i for i, f in enumerate(names)}

    def read(self, texts: list[tuple[int, list[int], list[tuple[int, ...]]]]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The sum of all marginals of each text, and the words of a half or more where it has known features."""
        mass, marked = np.zeros(len(texts)), {}
        full = [i for i, t in enumerate(texts) if t[0]]
        if not full:
            return mass, marked
        anchors = Anchors([texts[i] for i in full])
        found = Messages(anchors, anchors.emission(self.weights, self.bias), self.bias, self.trans)
        mass[full] = np.bincount(anchors.text, weights=found.marginal + found.stretch)
        ends = np.cumsum([len(texts[i][1]) for i in full])
        for i, end in zip(full, ends.tolist()):
            if any(texts[i][2]):
                marked[i] = np.flatnonzero(found.of_text(anchors.place[end - len(texts[i][1]) : end]) >= 0.5)
        return mass, marked

    def scores(self, mass: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log(mass + 1e-6) + shift, -30, 30)))


def fit_chain(texts: list[list[str]], toxic: list[bool]) -> Chain:
    """Label words, fit the chain and then the curve on whole texts."""
    names = telling_features(texts, toxic)
    known = Known({f: i for i, f in enumerate(names)})
    found = [anchored(words, known) for words in texts]
    weights, bias, trans = np.zeros(len(names)), -5.0, np.zeros((2, 2))
    if names:
        anchors = Anchors([t for t in found if t[0]])
        bad = np.array([b for t, b in zip(found, toxic) if t[0]])[anchors.text]
        y = np.zeros(len(anchors.text))
        y[anchors.where] = 1.0
        y *= bad
        seen = np.zeros((2, 2))
        follows = anchors.next >= 0
        to = np.where(follows, y[anchors.next], 0.0).astype(int)
        state, some = y.astype(int), anchors.gap > 0
        np.add.at(seen, (state[some], 0), 1)
        seen[0, 0] += (anchors.gap[some] - 1).sum()
        np.add.at(seen, (np.where(some, 0, state)[follows], to[follows]), 1)
        grads = [np.zeros(len(names)), np.zeros(1), np.zeros((2, 2))]
        for _ in range(ROUNDS):
            m = Messages(anchors, anchors.emission(weights, bias), bias, trans)
            miss = y - m.marginal
            steep = (
                np.bincount(anchors.feature, weights=miss[anchors.where], minlength=len(names)) - 0.01 * weights,
                np.array([miss.sum() - m.stretch.sum()]),
                seen - m.pairs() - 0.01 * trans,
            )
            for total, g in zip(grads, steep):
                total += g * g
            moved = [0.5 * g / np.sqrt(t + 1e-8) for g, t in zip(steep, grads)]
            weights, bias, trans = weights + moved[0], bias + float(moved[1][0]), trans + moved[2]
    chain = Chain(names, weights, bias, trans, (1.0, 0.0))
    x = np.log(chain.read(found)[0] + 1e-6)
    y = np.array(toxic, float)
    slope, shift = 1.0, 0.0
    if 0 < y.sum() < len(y):
        for _ in range(50):  # Newton steps for two parameters
            p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-6)
            design = np.stack([x, np.ones_like(x)])
            step = np.linalg.solve((design * h) @ design.T + 1e-2 * np.eye(2), design @ (y - p) - 1e-2 * np.array([slope, shift]))
            slope, shift = slope + float(np.clip(step[0], -1, 1)), shift + float(np.clip(step[1], -1, 1))
    else:
        shift = -20.0
    chain.curve = (slope, shift)
    return chain


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` ids of either label that may be learnt from: ``(label_id, bad)``, the bound for sending it to tasks."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    per = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    rows = per.select(F.col("doc_id").alias("label_id"), (F.col("toxic") == 1).alias("bad"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    return rows.where("bad").orderBy(*order).limit(limit).union(rows.where("NOT bad").orderBy(*order).limit(limit))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = {}
    for batch in batches:
        for i, text, bad in zip(*(batch.column(c).to_pylist() for c in ("label_id", "text", "bad"))):
            seen[(i, text)] = bad
    # In the order of ids, whatever the order of arrival: reruns agree.
    rows = [(text, bad) for (_, text), bad in sorted(seen.items())]
    c = fit_chain([_WORD.findall(t) for t, _ in rows], [b for _, b in rows])
    model = [c.names, c.weights.tolist(), c.bias, c.trans.tolist(), list(c.curve)]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], names=["model"])


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Chain:
    sample = stage(labelled_sample(labels, limit), "labelled")
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    texts = stage(texts.select("label_id", F.coalesce("text", F.lit("")).alias("text"), "bad"), "labelled_texts")
    names, weights, bias, trans, curve = json.loads(texts.coalesce(1).mapInArrow(_fit_task, "model string").first()[0])
    return Chain(names, np.array(weights), bias, np.array(trans), tuple(curve))


def _scorer(chain: Chain):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(chain.numbers)
        for batch in batches:
            texts = batch.column("text")
            mass, marked = chain.read([anchored(_WORD.findall(t.as_py() or ""), known) for t in texts])
            scores, spans = chain.scores(mass), []
            for i in range(len(texts)):
                at = marked.get(i, ())
                where = [m.span() for m in _WORD.finditer(texts[i].as_py())] if len(at) else []
                spans.append([{"begin": where[k][0], "end": where[k][1]} for k in at])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "held_out", "score", "spans"],
            )

    return score


def scored(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Per row of ``documents``: its score, the prediction, and the spans of offending words."""
    chain = fit(documents, labels, limit)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, spans array<struct<begin: int, end: int>>"
    out = rows.mapInArrow(_scorer(chain), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))
