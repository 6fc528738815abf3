"""The trained models against brute force: marginals over all paths, gradients by differences, labels by enumeration."""

import itertools
import math

import numpy as np
import pytest

from citeforge.llm import langid, toxicity


def field(rng, words=6, heads=3):
    f = toxicity.ToxicField()
    f.words, f.heads = {f"w{k}": k for k in range(1, words + 1)}, {f"h{k}": k for k in range(1, heads + 1)}
    f.token, f.head, f.before, f.after = (rng.normal(size=n + 1) * (np.arange(n + 1) > 0) for n in (words, heads, words, words))
    f.bias, f.trans, f.start = -0.4, rng.normal(size=(2, 2)), rng.normal(size=2)
    return f


def chains(rng, n=3, length=5):
    w, h = rng.integers(0, 7, (n, length)), rng.integers(0, 4, (n, length))
    valid = np.arange(length) < rng.integers(2, length + 1, n)[:, None]
    return w * valid, h * valid, valid


def paths(f, w, h, valid):
    """Every labelling of one chain with its score."""
    e = f.emissions(w[None], h[None], valid[None])[0]
    n = int(valid.sum())
    for y in itertools.product((0, 1), repeat=n):
        yield y, f.start[y[0]] + sum(e[t] for t in range(n) if y[t]) + sum(f.trans[a, b] for a, b in zip(y, y[1:]))


def test_marginals_over_all_paths():
    rng = np.random.default_rng(1)
    f = field(rng)
    w, h, valid = chains(rng)
    marginal, pairs, log_z = f.forward_backward(f.emissions(w, h, valid), valid)
    want_pairs = np.zeros((2, 2))
    for k in range(len(w)):
        every = list(paths(f, w[k], h[k], valid[k]))
        z = sum(math.exp(s) for _, s in every)
        assert log_z[k] == pytest.approx(math.log(z))
        for t in range(int(valid[k].sum())):
            assert marginal[k, t, 1] == pytest.approx(sum(math.exp(s) for y, s in every if y[t]) / z)
        for y, s in every:
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += math.exp(s) / z
    assert pairs == pytest.approx(want_pairs)


def test_gradient_of_the_field():
    rng = np.random.default_rng(2)
    f = field(rng)
    w, h, valid = chains(rng)
    gold = rng.random(w.shape) * valid
    pair_gold, start_gold = rng.random((2, 2)), rng.random(2)
    start_gold *= len(w) / start_gold.sum()
    pair_gold *= valid[:, 1:].sum() / pair_gold.sum()
    _, g = f.gradient(w, h, valid, gold, pair_gold, start_gold)
    params = f.parameters()
    for name, a in params.items():
        for at in np.ndindex(a.shape):
            if name in ("token", "head", "before", "after") and at == (0,):
                continue
            value = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in params.items()}
                moved[name][at] += step
                f.assign(moved)
                value.append(f.gradient(w, h, valid, gold, pair_gold, start_gold)[0])
            assert (value[0] - value[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-6), (name, at)


def test_soft_labels_by_enumeration():
    """Two chains of one toxic document and one of a clean one: posteriors given the labels."""
    rng = np.random.default_rng(3)
    f = field(rng)
    w, h, valid = chains(rng, 3, 4)
    leak = f.leak
    gold, pairs, start = f.labels(w, h, valid, np.array([0, 0, -1]))
    first, second = (list(paths(f, w[k], h[k], valid[k])) for k in (0, 1))
    every = [(y + z, math.exp(s + t) * (1 if any(y + z) else leak)) for y, s in first for z, t in second]
    total, n = sum(p for _, p in every), int(valid[0].sum())
    got = np.concatenate([gold[0][valid[0]], gold[1][valid[1]]])
    assert got == pytest.approx([sum(p for y, p in every if y[t]) / total for t in range(len(got))])
    assert not gold[2].any()
    want = np.array([[0.0, 0.0], [0.0, 0.0]])
    want[0, 0] += valid[2].sum() - 1
    for y, p in every:
        for part in (y[:n], y[n:]):
            for a, b in zip(part, part[1:]):
                want[a, b] += p / total
    assert pairs == pytest.approx(want)
    assert start == pytest.approx([3 - gold[:, 0].sum(), gold[:, 0].sum()])


def test_gradient_of_the_network():
    """Backpropagation through time against differences, in both directions."""
    rng = np.random.default_rng(4)
    net = langid.ByteGru(["a", "b", "c"], hidden=4)
    x, y = rng.integers(1, 256, (7, 5)), rng.integers(0, 3, 5)
    valid = (np.arange(7)[:, None] < rng.integers(3, 8, 5)).astype(np.float32)
    _, g = net.step(x, y, valid)
    for name, a in net.w.items():
        places = list(np.ndindex(a.shape)) if name != "x" else [(d, k, x[t, 0]) for d in (0, 1) for k in range(0, 12, 3) for t in range(3)]
        for at in places[:: max(1, len(places) // 40)]:
            value = []
            for step in (1e-2, -1e-2):
                was = a[at]
                a[at] = was + step
                value.append(net.step(x, y, valid)[0])
                a[at] = was
            assert (value[0] - value[1]) / 2e-2 == pytest.approx(g[name][at], abs=2e-4), (name, at)
