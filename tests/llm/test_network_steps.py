"""The network of op 7: a step takes each exponential once, and is the plain step; words are counted where they are read."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lociframe.llm import pseudolm as lm

SHAPE = (5, 16)


def batch(n, rng):
    size = SHAPE[0] * SHAPE[1]
    return rng.integers(0, size + 1, (n, 2 * lm.REACH)), rng.integers(0, size, n)


def network(scale=0.3):
    rng = np.random.default_rng(3)
    return lm.Network(rng.normal(0, scale, sum(int(np.prod(s)) for s in lm.Network.shapes(*SHAPE))), SHAPE)


def plain_step(weights, around, target):
    """The weights after one Adagrad step from the start, in doubles, target by target."""
    side, bias, tc, cb, tm, mb = [w.astype(float) for w in weights]
    grads = [np.zeros_like(w) for w in (side, bias, tc, cb, tm, mb)]
    for row, t in zip(around, target, strict=True):
        h = np.tanh(bias + sum(side[p, e] for p, e in enumerate(row)))
        k, m = divmod(int(t), SHAPE[1])
        back = np.zeros(lm.HIDDEN)
        for w, b, pick, at in ((tc, cb, k, ()), (tm[k], mb[k], m, (k,))):
            z = h @ w + b
            error = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            error[pick] -= 1
            error /= len(target)
            first = 2 if at == () else 4
            grads[first][at] += np.outer(h, error)
            grads[first + 1][at] += error
            back += w @ error
        back *= 1 - h * h
        grads[1] += back
        for p, e in enumerate(row):
            grads[0][p, e] += back
    seen = [1e-2 + (g**2).mean(2, keepdims=True) if k == 0 else 1e-2 + g**2 for k, g in enumerate(grads)]
    return [w - lm.RATE * g / np.sqrt(s) for w, g, s in zip((side, bias, tc, cb, tm, mb), grads, seen, strict=True)]


@pytest.mark.parametrize("scale", [0.3, 8.0])  # with the larger one logits go beyond SAFE
def test_a_step_is_the_plain_step(scale):
    around, target = batch(lm.ROWS + 700, np.random.default_rng(1))
    net = network(scale)
    assert net._safe() == [scale < 1] * 2
    want = plain_step(net.weights, around, target)
    net.learn(around, target)
    for got, w in zip(net.weights, want, strict=True):
        assert np.allclose(got, w, atol=2e-3)
    again = lm.Network(net.flat(), SHAPE)  # the views of the tables are what is written
    assert np.array_equal(again.log_probs(around, target), net.log_probs(around, target))


def test_each_exponential_is_taken_once(monkeypatch):
    taken, exp = [0], np.exp

    def counted(x, *args, **kwargs):
        taken[0] += np.size(x)
        return exp(x, *args, **kwargs)

    around, target = batch(3000, np.random.default_rng(2))
    net = network()
    monkeypatch.setattr(lm.np, "exp", counted)
    net.learn(around, target)
    assert taken[0] == 3000 * sum(SHAPE)


def test_words_are_counted_where_they_are_read(make_docs):
    texts = ["Été été A-b a_B 12 ½", None, "", " .,\n", "b b\tB a b", "x" * 70_000]
    docs = make_docs([(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(1)
    counts = lm.word_counts(docs)
    want = Counter()
    for t in texts:
        if t:
            want.update("".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t).split(" "))
    del want[""]
    assert {r.word: r.n for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row per word
    assert lm.word_strings(lm.words_of(pa.array(["", None]))).to_pylist() == []
