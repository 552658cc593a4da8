"""Stacks of instances give what each gives alone, and their rows are dealt over the cores."""

import os

import numpy as np
import pytest

import __spark_entry__
from fathom.functions import descent, local, solvers, steppers
from fathom.functions import lockstep as L

DATA = "/root/testdata/sf0.001"
SPREAD = ["constrained_minimisers", "boundary_values", "integrators", "oscillators", "minimisers", "roots_and_integrals", "tridiagonal_systems"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SPREAD)
def test_small_files_are_worked_on_by_all_cores(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).rdd.getNumPartitions() >= 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_draws_of_a_small_file_are_made_by_all_cores(spark):
    plan = __spark_entry__.queries()["sampler_moments"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan


def _wavy(v, r):
    return ((v - r.c) ** 2).sum(0) + 0.3 * (1 - np.cos(2 * (v[0] - r.c[0]))) + v[0] * v[-1] / 4


STACKS = {
    **{k.__name__: lambda f, x, r, k=k: k(f, x, rows=r) for k in (descent.gradient_descent, descent.conjugate_gradients, descent.lbfgs, descent.trust_region, local.bfgs, solvers.nelder_mead)},
    "projected": lambda f, x, r: descent.projected_gradient(f, x, lambda v, r: np.clip(v, -1, 2), rows=r),
    "lagrangian": lambda f, x, r: descent.augmented_lagrangian(f, x, [lambda v, r: v[0] - v[1] + 1], rows=r),
    "annealing": lambda f, x, r: descent.annealing(f, x, rounds=300, rows=r),
    "swarm": lambda f, x, r: descent.swarm(f, [-5, -5], [5, 5], 10, 60, rows=r),
}


@pytest.mark.parametrize("name", STACKS)
def test_an_instance_does_not_depend_on_its_stack(name):
    c = np.random.default_rng(3).normal(size=(2, 7)) * 2
    whole, told = STACKS[name](_wavy, np.zeros((2, 7)), L.Rows(7, {"c": c}))
    for k in range(7):
        one, d = STACKS[name](_wavy, np.zeros((2, 1)), L.Rows(1, {"c": c[:, k : k + 1]}))
        assert np.allclose(one[:, 0], whole[:, k], atol=1e-9) and d["rounds"][0] == told["rounds"][k]


def test_elimination():
    g = np.random.default_rng(1)
    m, b = g.normal(size=(3, 3, 50)), g.normal(size=(3, 50))
    m[0, 0, :5] = 0
    assert np.allclose(L.solve(m, b), np.linalg.solve(m.transpose(2, 0, 1), b.T[:, :, None])[:, :, 0].T)


def test_rows_without_numbers_give_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 3.0)], "id long, a double")
    got = {r.id: r.y for r in L.together(df, "id", lambda r: [r.a, 2 * r.a]).collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: None, 4: [3.0, 6.0]}


def test_stacks_of_boundary_values():
    end = np.array([0.5, 1.0, 2.0])
    assert np.allclose(steppers.shooting(lambda t, y, v: -y, 0.0, end, 0.0, np.sin(end), -9.0, 9.0), 1, atol=1e-8)
    t, y = steppers.chebyshev_bvp(lambda t: t, lambda t: 1 + t, lambda t: 0 * t, 0.0, end, 0.0, np.sin(end), 16)
    for k, e in enumerate(end.tolist()):
        u, v = steppers.chebyshev_bvp(lambda t: t, lambda t: 1 + t, lambda t: 0 * t, 0.0, e, 0.0, np.sin(e), 16)
        assert np.allclose(t[:, k], u) and np.allclose(y[:, k], v, atol=1e-12)


METHODS = {
    "rk4": lambda f, y, e: local.rk4(f, y, 0.0, e, 50),
    "rk45": lambda f, y, e: solvers.rk45(f, y, 0.0, e)[1],
    **{k: lambda f, y, e, k=k: solvers.implicit(f, y, 0.0, e, 50, k) for k in ("euler", "trapezoid", "bdf2")},
    "explicit": lambda f, y, e: steppers.euler(f, y, 0.0, e, 50),
    "third order": lambda f, y, e: steppers.bogacki_shampine(f, y, 0.0, e)[0],
    "multistep": lambda f, y, e: steppers.adams_bashforth(f, y, 0.0, e, 50),
    "linearly implicit": lambda f, y, e: steppers.rosenbrock(f, y, 0.0, e, 50),
}


@pytest.mark.parametrize("name", METHODS)
def test_stacks_of_trajectories(name):
    w, end, y0 = np.array([0.5, 2.0, 9.0]), np.array([2.0, 0.7, 1.0]), np.array([[1.0, 2.0, -1.0], [0.0, 1.0, 3.0]])
    field = lambda w: lambda t, y: np.stack([y[1], -w * y[0] - 0.1 * y[1] ** 2 + np.cos(t)])
    got = METHODS[name](field(w), y0, end)
    for k in range(3):
        assert np.allclose(got[:, k], METHODS[name](field(w[k]), y0[:, k], end[k]), rtol=1e-11, atol=1e-12)
