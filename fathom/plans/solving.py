"""Queries of the one-instance-a-row kernels, with the exact answers in SQL; answers are rounded to what the kernels promise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import descent, local, lockstep, solvers, steppers


def _rows(s, d):
    return t(s, d, "supplier").select("s_suppkey", (1 + F.col("s_nationkey") / 10).alias("a"), (0.5 + F.pmod(F.col("s_acctbal"), F.lit(2.0))).alias("b"))


_AB = "WITH x AS (SELECT s_suppkey, 1 + s_nationkey / 10.0::DOUBLE AS a, 0.5 + (s_acctbal - 2 * floor(s_acctbal / 2)) AS b FROM supplier)"


def _each(s, d, f, names, *digits):
    return _named(solvers.each(_rows(s, d), "s_suppkey", f), names, digits)


def _together(s, d, f, names, *digits):
    """f of stacks of suppliers."""
    return _named(lockstep.together(_rows(s, d), "s_suppkey", f), names, digits)


def _named(out, names, digits):
    return out.select("s_suppkey", *(F.round(F.col("y")[k], digits[min(k, len(digits) - 1)]).alias(n) for k, n in enumerate(names)))


@query(f"{_AB} SELECT s_suppkey, round(sqrt(a), 6) AS bisect, round(power(b, 1.0 / 3), 6) AS newton, round(a, 6) AS golden, round(b * b * b / 3 + a * b, 6) AS simpson, round(2 * a * b, 6) AS slope_a, round(a * a + cos(b), 6) AS slope_b FROM x")
def roots_and_integrals(s, d):
    def f(r):
        g = local.gradient(lambda v: v[0] ** 2 * v[1] + math.sin(v[1]), np.array([r.a, r.b]))
        return [local.bisect(lambda x: x * x - r.a, 0, 10), local.newton(lambda x: x**3 - r.b, lambda x: 3 * x * x, 1.0), local.golden_section(lambda x: (x - r.a) ** 2, -5, 9), local.simpson(lambda x: x * x + r.a, 0, r.b), *g]

    return _each(s, d, f, ["bisect", "newton", "golden", "simpson", "slope_a", "slope_b"], 6)


@query(f"{_AB} SELECT s_suppkey, round(a * cos(b), 4) AS rk4, round(a * cos(b), 4) AS rk45, round(a * exp(-b), 3) AS implicit, round(a * cos(b), 3) AS verlet FROM x")
def oscillators(s, d):
    """Trajectories of y'' = -y, and of y' = -y, to the time b."""

    def f(r):
        turn = lambda u, y: np.stack([y[1], -y[0]])
        y0 = np.stack([r.a, 0 * r.a])
        _, adaptive, _ = solvers.rk45(turn, y0, 0.0, r.b)
        decay = solvers.implicit(lambda u, y: -y, y0[:1], 0.0, r.b, 400)
        x, _ = solvers.verlet(lambda q: -q, y0[:1], 0 * y0[:1], r.b / 2000, 2000)
        return [local.rk4(turn, y0, 0.0, r.b, 200)[0], adaptive[0], decay[0], x[0]]

    return _together(s, d, f, ["rk4", "rk45", "implicit", "verlet"], 4, 4, 3, 3)


_SEARCHES = {"gradient": descent.gradient_descent, "conjugate": descent.conjugate_gradients, "lbfgs": descent.lbfgs, "region": descent.trust_region, "bfgs": local.bfgs, "simplex": solvers.nelder_mead}


@query(f"{_AB} SELECT s_suppkey, {', '.join(f'round(a, 3) AS {k}_x, round(b, 3) AS {k}_y' for k in _SEARCHES)} FROM x")
def minimisers(s, d):
    """The lowest point of a tilted bowl, by six searches."""

    def f(r):
        bowl = lambda v, r: (v[0] - r.a) ** 2 + 3 * (v[1] - r.b) ** 2 + (v[0] - r.a) * (v[1] - r.b)
        return [x for search in _SEARCHES.values() for x in search(bowl, np.zeros((2, len(r))), rows=r)[0]]

    return _together(s, d, f, [f"{k}_{n}" for k in _SEARCHES for n in "xy"], 3)


@query(f"{_AB} SELECT s_suppkey, round(least(a, 2), 3) AS boxed, round(-a, 3) AS on_line, round(a, 3) AS swarm, round(a, 3) AS annealed FROM x")
def constrained_minimisers(s, d):
    """The nearest point to a within [0, 2], the lowest of x^2 + y^2 on the line x - y = -2a, and two searches of a wavy bowl."""

    def f(r):
        near = lambda v, r: (v[0] - r.a) ** 2
        wavy = lambda v, r: near(v, r) + 1 - np.cos(3 * (v[0] - r.a))
        one, two = np.zeros((1, len(r))), np.zeros((2, len(r)))
        line = descent.augmented_lagrangian(lambda v, r: v[0] ** 2 + v[1] ** 2, two, [lambda v, r: v[0] - v[1] + 2 * r.a], rows=r)[0]
        boxed = descent.projected_gradient(near, one, lambda v, r: np.clip(v, 0, 2), rows=r)[0]
        return [boxed[0], line[0], descent.swarm(wavy, [-9], [9], 15, 120, rows=r)[0][0], descent.annealing(wavy, one, rounds=2000, rows=r)[0][0]]

    return _together(s, d, f, ["boxed", "on_line", "swarm", "annealed"], 3)


@query(f"{_AB} SELECT s_suppkey, round((15 * a - 4 * b + 1) / 56, 9) AS x0, round((16 * b - 4 * a - 4) / 56, 9) AS x1, round((15 - 4 * b + a) / 56, 9) AS x2 FROM x")
def tridiagonal_systems(s, d):
    """[4 1 0; 1 4 1; 0 1 4] x = (a, b, 1)."""
    return _each(s, d, lambda r: solvers.tridiagonal(np.array([0.0, 1.0, 1.0]), np.full(3, 4.0), np.array([1.0, 1.0, 0.0]), np.array([r.a, r.b, 1.0])), ["x0", "x1", "x2"], 9)


@query(f"{_AB} SELECT s_suppkey, round(a * cos(b), 3) AS third_order, round(a * cos(b), 5) AS multistep, round(a * cos(b), 3) AS linearly_implicit, round(a * cos(b), 1) AS explicit FROM x")
def integrators(s, d):
    def f(r):
        turn, y0 = lambda u, y: np.stack([y[1], -y[0]]), np.stack([r.a, 0 * r.a])
        return [steppers.bogacki_shampine(turn, y0, 0.0, r.b)[0][0], steppers.adams_bashforth(turn, y0, 0.0, r.b, 400)[0], steppers.rosenbrock(turn, y0, 0.0, r.b, 3000)[0], steppers.euler(turn, y0, 0.0, r.b, 4000)[0]]

    return _together(s, d, f, ["third_order", "multistep", "linearly_implicit", "explicit"], 3, 5, 3, 1)


@query(f"{_AB} SELECT s_suppkey, round(a, 5) AS shot, round(a * sin(b / 2), 6) AS spectral FROM x")
def boundary_values(s, d):
    """y'' = -y from 0 to a sin b: the slope at 0, and the value half way."""

    def f(r):
        end = r.a * np.sin(r.b)
        shot = steppers.shooting(lambda t, y, v: -y, 0.0, r.b, 0.0, end, -20.0, 20.0, 100)
        _, y = steppers.chebyshev_bvp(lambda t: 0 * t, lambda t: 1 + 0 * t, lambda t: 0 * t, 0.0, r.b, 0.0, end, 16)
        return [shot, y[8]]

    return _together(s, d, f, ["shot", "spectral"], 5, 6)
