"""The chain over whole texts against plain messages word by word."""

import random

import numpy as np
import pytest

from tally.llm import toxicity


def plain_marginals(emission, trans):
    """Marginals of state 1 and expected moves of one text, word by word."""
    n, move = len(emission), np.exp(trans)
    obs = np.stack([np.ones(n), np.exp(emission)], axis=1)
    ahead, behind = [obs[0] / obs[0].sum()], [np.ones(2)]
    for t in range(1, n):
        a = (ahead[-1] @ move) * obs[t]
        ahead.append(a / a.sum())
    for t in range(n - 1, 0, -1):
        b = move @ (obs[t] * behind[0])
        behind.insert(0, b / b.sum())
    both = np.array(ahead) * np.array(behind)
    moves = np.zeros((2, 2))
    for t in range(1, n):
        pair = ahead[t - 1][:, None] * move * (obs[t] * behind[t])[None, :]
        moves += pair / pair.sum()
    return both[:, 1] / both.sum(1), moves


@pytest.mark.parametrize("seed", range(8))
def test_stretches_are_those_of_single_words(seed):
    rng = np.random.default_rng(seed)
    trans, bias = rng.normal(size=(2, 2)) * (0.0 if seed == 0 else 2.0), float(rng.normal() * 2 - 2)
    weights = rng.normal(size=5) * 3
    texts, want = [], []
    for n in (1, 2, 3, 700, 64, 65, 30, 1):
        known = [tuple(rng.integers(0, 5, rng.integers(1, 3)).tolist()) if rng.random() < 0.1 else () for _ in range(n)]
        at = [i for i, f in enumerate(known) if f or not i]
        texts.append((n, at, [known[i] for i in at]))
        want.append(plain_marginals(np.array([bias + sum(weights[k] for k in f) for f in known]), trans))
    anchors = toxicity.Anchors(texts)
    found = toxicity.Messages(anchors, anchors.emission(weights, bias), bias, trans)
    assert found.pairs() == pytest.approx(sum(m for _, m in want), rel=1e-8)
    mass = np.bincount(anchors.text, weights=found.marginal + found.stretch)
    assert mass == pytest.approx([p.sum() for p, _ in want], rel=1e-8)
    end = 0
    for (_, at, _), (p, _) in zip(texts, want):
        end += len(at)
        assert found.of_text(anchors.place[end - len(at) : end]) == pytest.approx(p, rel=1e-8, abs=1e-12)


def test_a_fit_on_single_words_is_the_same(monkeypatch):
    """The gradient over stretches is that of a chain in which every word is an anchor."""
    rng = random.Random(2)
    plain = [f"wort{i}" for i in range(50)]
    texts = [[rng.choice(plain) for _ in range(rng.randrange(1, 90))] for _ in range(120)]
    toxic = [i % 3 == 0 for i in range(120)]
    for words, bad in zip(texts, toxic):
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grr", "pfui", "bah"]))
    short = toxicity.fit_chain(texts, toxic)

    def every_word(words, known):
        return len(words), list(range(len(words))), [known[w] for w in words]

    monkeypatch.setattr(toxicity, "anchored", every_word)
    long = toxicity.fit_chain(texts, toxic)
    assert short.names == long.names and {"grr", "pfui", "bah"} <= set(short.names)
    assert short.weights == pytest.approx(long.weights, rel=1e-5) and short.bias == pytest.approx(long.bias, rel=1e-5)
    assert short.trans == pytest.approx(long.trans, rel=1e-5) and short.curve == pytest.approx(long.curve, rel=1e-4)


def test_features_stand_apart_from_a_plain_count():
    texts = [["a", "grr"], ["b", "grr"], ["c", "grr"], ["d", "grr"], ["e", "x"]] + [["y", "x"]] * 400
    toxic = [True] * 5 + [False] * 400
    assert toxicity.telling_features(texts, toxic) == ["grr"]


def test_nothing_depends_on_a_border():
    """A word's marginal is the same wherever plain words in front put it, once they are many."""
    chain = toxicity.Chain(["grr"], np.array([6.0]), -3.0, np.array([[0.5, -1.0], [-1.0, 1.5]]), (1.0, 0.0))
    known = toxicity.Known(chain.numbers)
    masses = [chain.read([toxicity.anchored(["x"] * n + ["grr"] * 2 + ["x"] * 100, known)]) for n in range(60, 70)]
    grown = np.diff([m[0] for m, _ in masses])
    assert grown == pytest.approx(grown[0], rel=1e-6)
    assert [marked[0].tolist() for _, marked in masses] == [list(range(n, n + 2)) for n in range(60, 70)]
