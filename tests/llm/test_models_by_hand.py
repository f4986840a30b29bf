"""Learned operators against plain rewrites: the best label sequence, the risk, and blocks of formulas."""

import itertools
import random

import numpy as np
import pytest

from pulseframe.llm import extraction, quality


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_of_all_sequences(seed):
    pick = random.Random(seed)
    names = [f"f{i}" for i in range(12)]
    field = extraction.Field({n: pick.uniform(-2, 2) for n in names}, tuple(tuple(pick.uniform(-2, 2) for _ in range(2)) for _ in range(2)))
    for length in range(1, 9):
        page = [pick.sample(names, pick.randint(0, 5)) for _ in range(length)]

        def score(labels):
            own = sum(field.weights[f] for block, y in zip(page, labels) if y for f in block)
            return own + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(map(score, itertools.product((0, 1), repeat=length)))
        assert score([int(x) for x in field.decode(page)]) == pytest.approx(best)


def risk(model, positive, unlabelled, prior):
    """The non-negative risk with the logistic loss, and what keeps weights small."""
    loss = lambda x, y: np.mean(np.log1p(np.exp(-y * model.margin(x))))
    bad = loss(unlabelled, -1) - prior * loss(positive, -1)
    return prior * loss(positive, 1) + max(0.0, bad) + quality.DECAY / 2 * (model.weights**2).sum()


def test_the_fit_has_the_least_risk_around():
    """No step away from the fitted weights lowers the risk by a hundredth of what the fit has taken off;
    a fixed number of steps on a risk with a kink ends near its least value, not at it."""
    pick = np.random.default_rng(3)
    truth = pick.random(1500) < 0.6
    unlabelled = pick.normal(np.where(truth, 0.7, -0.7)[:, None], 1, (1500, quality.MEASURES))
    positive = pick.normal(0.7, 1, (700, quality.MEASURES))
    model = quality.fit(positive, unlabelled, 0.6)
    least = risk(model, positive, unlabelled, 0.6)
    nothing = quality.Model(model.cuts, np.zeros_like(model.weights), 0.0)
    most = risk(nothing, positive, unlabelled, 0.6)
    assert least < 0.7 * most
    for size in (0.01, 0.1, 0.5):
        for _ in range(30):
            step = pick.normal(0, size, len(model.weights))
            moved = quality.Model(model.cuts, model.weights + step, model.constant + pick.normal(0, size))
            assert risk(moved, positive, unlabelled, 0.6) > least - 0.01 * (most - least)


def test_formulas_and_fallbacks_are_read_in_their_line():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> be, <object data=a>or not</object>.</p><p>Next"
    assert [b.text for b in extraction.blocks(page)] == ["Let x=2 be, or not.", "Next"]
