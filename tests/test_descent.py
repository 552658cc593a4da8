"""Minimisers reach known lowest points."""

import numpy as np
import pytest

from fathom.functions import descent as D


def bowl(x):
    return (x[0] - 1) ** 2 + 3 * (x[1] + 2) ** 2 + (x[0] - 1) * (x[1] + 2)


def valley(x):
    return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2


@pytest.mark.parametrize("how", [D.gradient_descent, D.conjugate_gradients, D.lbfgs, D.trust_region])
def test_smooth_functions(how):
    x, told = how(bowl, np.zeros(2))
    assert np.allclose(x, [1, -2], atol=1e-4) and told["converged"] and told["value"] < 1e-8
    if how is not D.gradient_descent:
        assert np.allclose(how(valley, np.array([-1.2, 1.0]))[0], [1, 1], atol=1e-3)


def test_scaled_steps():
    for decay in (None, 0.9):
        assert np.allclose(D.scaled_descent(bowl, np.zeros(2), decay=decay)[0], [1, -2], atol=0.05)


def test_constraints():
    x, told = D.projected_gradient(bowl, np.array([3.0, 3.0]), lambda v: np.clip(v, 0, 2))
    # at y = 0 the slope in x is 2 (x - 1) + 2, so x goes to its end
    assert told["converged"] and np.allclose(x, [0, 0], atol=1e-4)
    x, told = D.augmented_lagrangian(lambda v: v[0] + v[1], np.array([0.3, 0.2]), [lambda v: v[0] ** 2 + v[1] ** 2 - 2])
    assert told["converged"] and np.allclose(x, [-1, -1], atol=1e-4)


def test_global_searches():
    waves = lambda x: float(np.sum(x * x + 5 * (1 - np.cos(2 * x))))
    assert np.allclose(D.swarm(waves, [-8, -8], [8, 8])[0], 0, atol=1e-3)
    assert np.allclose(D.annealing(waves, np.array([6.0, -6.0]))[0], 0, atol=1e-3)
