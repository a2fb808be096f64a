"""Fits of autoregressions: the baseline's filter is designed once, and what predictors leave is what a plain loop leaves."""

from __future__ import annotations

import numpy as np
import pytest
from pulseframe.operators import autoregression, correction


def test_the_baseline_is_designed_once(monkeypatch):
    x = np.sin(np.arange(40.0))
    first = correction.baseline(x)
    monkeypatch.setattr(correction, "butterworth", lambda design: pytest.fail("designed again"))
    assert (correction.baseline(x) == first).all()


@pytest.mark.parametrize("n, order", [(1, 0), (5, 4), (9, 3), (40, 12)])
def test_what_predictors_leave(n, order):
    x = np.random.default_rng(n).normal(size=n)
    model = autoregression.Model(x, order)
    wanted = [x[t] - sum(p * x[t - 1 - k] for k, p in enumerate(model.predictors[min(t, order)])) for t in range(n)]
    assert model._rests(x) == pytest.approx(wanted, abs=1e-12)
