"""The risk and its minimiser held against plain implementations; the trigram index against plain search."""

import math
import random

import numpy as np
import pytest

from attestor.llm import secrets, toxicity


def sample(seed, n, features, dense):
    r = np.random.default_rng(seed)
    return [np.flatnonzero(r.random(features) < dense) for _ in range(n)]


def risk(w, bias, positive, unlabelled, prior):
    """(non-negative risk, its unlabelled part), straight from the definition."""
    z = lambda row: bias + sum(w[i] for i in row)
    loss = lambda x: math.log1p(math.exp(-x))
    mean = lambda values: sum(values) / len(values)
    rest = mean([loss(-z(x)) for x in unlabelled]) - prior * mean([loss(-z(x)) for x in positive])
    return prior * mean([loss(z(x)) for x in positive]) + max(0.0, rest), rest


def plain_fit(positive, unlabelled, features, prior, l1, steps, rate=0.05):
    """The same minimiser on dense lists, with numeric gradients of the definition."""
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    turned = 0
    for step in range(1, steps + 1):
        rest = risk(w[:-1], w[-1], positive, unlabelled, prior)[1]
        turned += rest < 0
        value = lambda x: risk(x[:-1], x[-1], positive, unlabelled, prior)[0 if rest >= 0 else 1] * (1 if rest >= 0 else -1)  # noqa: E731, B023
        g = np.array([(value(w + h) - value(w - h)) / 2e-5 for h in np.eye(features + 1) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w - pace * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - pace[:-1] * l1, 0)
    return w, turned


@pytest.mark.parametrize(("prior", "steps"), [(0.3, 12), (0.9, 25)])
def test_fit_is_that_of_the_definition(prior, steps):
    positive = [np.union1d(x, [0, 1]) for x in sample(1, 12, 6, 0.3)]
    unlabelled = sample(2, 20, 6, 0.3) + positive[:3]
    want, turned = plain_fit(positive, unlabelled, 6, prior, 1e-4, steps)
    w, bias = toxicity.fit_nnpu(positive, unlabelled, 6, prior, 1e-4, steps=steps)
    np.testing.assert_allclose([*w, bias], want, atol=2e-4)
    assert turned > 0 or prior < 0.5  # the second case does undo a fit below zero


@pytest.mark.parametrize("part", [1 << 22, 50])
def test_postings(monkeypatch, part):
    monkeypatch.setattr(secrets, "PART", part)
    r = random.Random(1)
    words = ["token", "TOKEN=", "api", "key", "AKIA", "eyJ", "xoxb-", "gh", "p_", "-----BEGIN", "é", "\u212a", " ", "\n", "x" * 70]
    texts = ["", "".join(words) * 3] + ["".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(200)]
    scanner = secrets.Scanner(secrets.RULES)
    got = scanner.postings(texts)
    assert set(got) == set(scanner.trigrams) and len(got) > 20
    for t, docs in got.items():
        assert docs.tolist() == [i for i, x in enumerate(texts) if t.encode() in x.encode().lower()], t
    assert all(len(x) == 0 for x in scanner.candidates([]))


def test_case_beyond_ascii():
    import re

    rule = [("k", "tokens", re.I, 0, 0)]
    assert secrets.Scanner(rule).scan(["to\u212aen\u017f"]) == [[(0, 0, 6)]]
