"""Integrators, boundary values and small networks against exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import layers as L
from fathom.functions import steppers as S


def turn(t, y):
    return np.array([y[1], -y[0]])


def test_integrators():
    want = [np.cos(2.0), -np.sin(2.0)]
    assert np.allclose(S.euler(turn, [1, 0], 0, 2, 20_000), want, atol=1e-3)
    assert np.allclose(S.bogacki_shampine(turn, [1, 0], 0, 2)[0], want, atol=1e-5)
    assert np.allclose(S.adams_bashforth(turn, [1, 0], 0, 2, 200), want, atol=1e-7)
    assert np.allclose(S.rosenbrock(turn, [1, 0], 0, 2, 1000), want, atol=1e-4)
    stiff = S.rosenbrock(lambda t, y: np.array([-1000 * (y[0] - np.cos(t))]), np.array([0.0]), 0, 1, 50)
    assert np.allclose(stiff, np.cos(1), atol=5e-3)


def test_order_of_the_linearly_implicit_method():
    off = [abs(S.rosenbrock(lambda t, y: -y * y + t, np.array([1.0]), 0, 1, n)[0] - S.rosenbrock(lambda t, y: -y * y + t, np.array([1.0]), 0, 1, 4000)[0]) for n in (20, 40, 80)]
    assert off[0] / off[1] > 3 and off[1] / off[2] > 3


def test_grids():
    n = 33
    x = np.linspace(0, 1, n)
    mode = np.outer(np.sin(np.pi * x), np.sin(2 * np.pi * x))
    assert np.allclose(S.heat_2d(mode, x[1], 1e-3, 20), mode * np.exp(-5 * np.pi**2 * 0.02), atol=5e-3)
    assert np.allclose(S.wave_2d(mode, np.zeros_like(mode), x[1], 0.01, 30), mode * np.cos(np.sqrt(5) * np.pi * 0.3), atol=1e-2)
    with pytest.raises(ValueError):
        S.wave_2d(mode, mode, x[1], 1.0, 1)


def test_boundary_values():
    assert S.shooting(lambda t, y, v: -y, 0, 1, 0, np.sin(1), 0, 3) == pytest.approx(1, abs=1e-8)
    t, y = S.chebyshev_bvp(lambda t: 0 * t, lambda t: 1 + 0 * t, lambda t: 0 * t, 0, 1, 0, np.sin(1), 16)
    assert np.allclose(y, np.sin(t), atol=1e-12) and (np.diff(t) > 0).all()


def test_network_slopes_and_training(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(40, 2))
    net = L.Network(L.Dense(2, 5, "tanh", 1)).add(L.Dense(5, 1, "identity", 2))
    want = (x[:, :1] * 2 - x[:, 1:]) ** 2
    loss = lambda: L.squared_loss(net.forward(x), want)
    value, slope = loss()
    net.backward(slope)
    w, d = net.layers[0].w, net.layers[0].dw[1, 3]
    w[1, 3] += 1e-6
    up = loss()[0]
    w[1, 3] -= 2e-6
    assert (up - loss()[0]) / 2e-6 == pytest.approx(d, rel=1e-4)
    w[1, 3] += 1e-6
    for _ in range(400):
        net.backward(loss()[1])
        net.adam(0.02)
    assert loss()[0] < value / 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x[:5]], "a double, b double")
    got = [r[0] for r in df.select(net.column(F.col("a"), F.col("b"))[0]).collect()]
    assert np.allclose(got, net.forward(x[:5])[:, 0])
