"""Queries of the dense kernels; closed forms of two and three dimensions in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import dense

_THREE = """WITH p AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS s, p_retailprice / 1000 AS r FROM part),
m AS (SELECT p_partkey, 4 + s AS a, r AS b, 1.0::DOUBLE AS c, 2 * r AS d, 5.0::DOUBLE AS e, 1.0::DOUBLE AS f, 1.0::DOUBLE AS g, 2.0::DOUBLE AS h, 6 + r AS i, 1.0::DOUBLE AS y0, 2.0::DOUBLE AS y1, s AS y2 FROM p),
n AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM m)"""
_X = """(y0 * (e * i - f * h) - b * (y1 * i - f * y2) + c * (y1 * h - e * y2)) / det AS {0}0, (a * (y1 * i - f * y2) - y0 * (d * i - f * g) + c * (d * y2 - y1 * g)) / det AS {0}1,
    (a * (e * y2 - y1 * h) - b * (d * y2 - y1 * g) + y0 * (d * h - e * g)) / det AS {0}2"""


def _three(s, d):
    x = t(s, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("s"), (F.col("p_retailprice") / 1000).alias("r"))
    one = F.lit(1.0)
    m = F.array(4 + F.col("s"), F.col("r"), one, 2 * F.col("r"), F.lit(5.0), one, one, F.lit(2.0), 6 + F.col("r"))
    return x.select("p_partkey", m.alias("m"), F.array(one, F.lit(2.0), F.col("s")).alias("y"))


def _spread(df, name, n, prefix):
    return [F.col(name)[k].alias(f"{prefix}{k}") for k in range(n)]


@query(f"""{_THREE} SELECT p_partkey, {_X.format("x")}, det, ((e * i - f * h) + (a * i - c * g) + (a * e - b * d)) / det AS inverse_trace,
    greatest(abs(a) + abs(d) + abs(g), abs(b) + abs(e) + abs(h), abs(c) + abs(f) + abs(i)) * greatest(abs(e * i - f * h) + abs(f * g - d * i) + abs(d * h - e * g),
    abs(c * h - b * i) + abs(a * i - c * g) + abs(b * g - a * h), abs(b * f - c * e) + abs(c * d - a * f) + abs(a * e - b * d)) / abs(det) AS condition_1, 3.0::DOUBLE AS rank FROM n""")
def dense_solve(s, d):
    """Linear systems, determinants, inverses, condition numbers and ranks, one matrix a part."""

    def f(m, y):
        return {"x": dense.solve(m, y), "det": dense.determinant(m), "inverse_trace": np.trace(dense.inverse(m), axis1=1, axis2=2), "condition_1": dense.condition_1(m), "rank": dense.rank(m)}

    out = dense.each(_three(s, d), f, "x array<double>, det double, inverse_trace double, condition_1 double, rank double", "m", "y", keep=["p_partkey"], width=3)
    return out.select("p_partkey", *_spread(out, "x", 3, "x"), "det", "inverse_trace", "condition_1", "rank")


@query(f"{_THREE} SELECT p_partkey, {_X.format('g')}, {_X.format('b')}, {_X.format('p')} FROM n")
def krylov_solve(s, d):
    """The same systems by residual minimisation, by stabilised bi-conjugate gradients, and by the pseudoinverse."""

    def f(m, y):
        return {"g": dense.krylov(m, y, "gmres"), "b": dense.krylov(m, y, "bicgstab"), "p": dense.least_squares(m, y)}

    out = dense.each(_three(s, d), f, "g array<double>, b array<double>, p array<double>", "m", "y", keep=["p_partkey"], width=3)
    return out.select("p_partkey", *(c for k in "gbp" for c in _spread(out, k, 3, k)))


_TWO = """WITH p AS (SELECT p_partkey, 3 + p_size / 10.0::DOUBLE AS a, p_retailprice / 1000 AS b, 2.0::DOUBLE AS c FROM part),
e AS (SELECT *, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS w0, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS w1 FROM p)"""


def _two(s, d, entries):
    a, b, c = 3 + F.col("p_size") / 10.0, F.col("p_retailprice") / 1000, F.lit(2.0)
    return t(s, d, "part").select("p_partkey", F.array(*entries(a, b, c)).alias("m"))


@query(f"""{_TWO} SELECT p_partkey, w0, w1, greatest(abs(w0), abs(w1)) AS s0, least(abs(w0), abs(w1)) AS s1, greatest(abs(w0), abs(w1)) / least(abs(w0), abs(w1)) AS condition_2,
    (exp(w1) * (a - w0) - exp(w0) * (a - w1)) / (w1 - w0) / exp(w1) AS exp_a, b * (exp(w1) - exp(w0)) / (w1 - w0) / exp(w1) AS exp_b, CASE WHEN abs(w0) > abs(w1) THEN w0 ELSE w1 END AS power, w0 AS lanczos0, w1 AS lanczos1,
    w0 AS least, (w0 < 0)::INTEGER::DOUBLE AS below, w1 AS near, a + 4 * b + 4 * c AS form, a * a + 2 * b * b + c * c AS inner FROM e""")
def dense_symmetric(s, d):
    """Eigenvalues by four methods, singular values, exponentials and forms of symmetric matrices."""

    def f(m):
        w, v = dense.symmetric_eigen(m)
        sv = np.linalg.svd(m, compute_uv=False)
        e = dense.exponential(m) / np.exp(w[:, 1])[:, None, None]
        report, power = dense.psd_report(m), dense.simultaneous_iteration(m, 1)[0]
        near = dense.rayleigh_quotient_iteration(m, v[:, :, 1] + 0.01)[0]
        x = np.broadcast_to(np.array([1.0, 2.0]), (len(m), 2))
        return {"w": w, "s": sv, "condition_2": dense.condition_2(m), "exp_a": e[:, 0, 0], "exp_b": e[:, 0, 1], "power": power[:, 0], "lanczos": dense.lanczos(m, 2), "least": report["least"], "below": report["below"],
                "near": near, "form": dense.quadratic_form(m, x), "inner": dense.inner(m, m)}

    fields = "w array<double>, s array<double>, condition_2 double, exp_a double, exp_b double, power double, lanczos array<double>, least double, below double, near double, form double, inner double"
    out = dense.each(_two(s, d, lambda a, b, c: (a, b, b, c)), f, fields, "m", keep=["p_partkey"], width=2)
    return out.select("p_partkey", *_spread(out, "w", 2, "w"), *_spread(out, "s", 2, "s"), "condition_2", "exp_a", "exp_b", "power", *_spread(out, "lanczos", 2, "lanczos"), "least", "below", "near", "form", "inner")


@query(f"""{_TWO} SELECT p_partkey, CASE WHEN abs(a) >= abs(b) THEN b / a ELSE a / b END AS l10, CASE WHEN abs(a) >= abs(b) THEN a ELSE b END AS u00, CASE WHEN abs(a) >= abs(b) THEN c - b * (2 * b) / a ELSE 2 * b - a * c / b END AS u11,
    sqrt(a * a + b * b) AS r00, (a * 2 * b + b * c) / sqrt(a * a + b * b) AS r01, abs(a * c - 2 * b * b) / sqrt(a * a + b * b) AS r11, greatest(sqrt(a * a + b * b), sqrt(4 * b * b + c * c)) AS pivoted,
    (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + 2 * b * b) AS re0, 0.0::DOUBLE AS im0, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + 2 * b * b) AS re1, c - b * 2 * b / a AS ilu FROM e""")
def dense_factors(s, d):
    """Triangular and orthogonal factors and eigenvalues of general matrices [[a, 2b], [b, c]]."""

    def f(m):
        _, l, u, _ = dense.lu(m)
        _, r = dense.qr(m)
        _, rp, _ = dense.qr_pivoted(m)
        w = dense.eigenvalues(m)
        return {"l10": l[:, 1, 0], "u00": u[:, 0, 0], "u11": u[:, 1, 1], "r00": r[:, 0, 0], "r01": r[:, 0, 1], "r11": r[:, 1, 1], "pivoted": rp[:, 0, 0], "re0": w[:, 0, 0], "im0": w[:, 0, 1], "re1": w[:, 1, 0], "ilu": dense.incomplete_lu(m)[:, 1, 1]}

    return dense.each(_two(s, d, lambda a, b, c: (a, 2 * b, b, c)), f, "l10 double, u00 double, u11 double, r00 double, r01 double, r11 double, pivoted double, re0 double, im0 double, re1 double, ilu double", "m", keep=["p_partkey"], width=2)


@query(f"""{_TWO}, q AS (SELECT *, a + b * b AS a2, c + b * b AS c2 FROM e)
SELECT p_partkey, sqrt(a2) AS l00, b / sqrt(a2) AS l10, sqrt(c2 - b * b / a2) AS l11, (c2 - 2 * b) / (a2 * c2 - b * b) AS x0, (2 * a2 - b) / (a2 * c2 - b * b) AS x1,
    (a2 / 4 + c2) / 2 - sqrt((a2 / 4 - c2) * (a2 / 4 - c2) / 4 + b * b / 4) AS g0, (a2 / 4 + c2) / 2 + sqrt((a2 / 4 - c2) * (a2 / 4 - c2) / 4 + b * b / 4) AS g1, 0.0::DOUBLE AS residual FROM q""")
def dense_positive(s, d):
    """Cholesky factors and solves, generalised eigenvalues beside diag(4, 1), and residuals of eigenpairs."""

    def f(m):
        n = len(m)
        l, x = dense.cholesky(m), dense.cholesky_solve(m, np.broadcast_to(np.array([1.0, 2.0]), (n, 2)))
        g, _ = dense.generalised_eigen(m, np.broadcast_to(np.diag([4.0, 1.0]), m.shape))
        r = dense.eigen_residuals(m, *dense.symmetric_eigen(m))
        return {"l00": l[:, 0, 0], "l10": l[:, 1, 0], "l11": l[:, 1, 1], "x": x, "g": g, "residual": np.round(sum(r.values()), 9)}

    out = dense.each(_two(s, d, lambda a, b, c: (a + b * b, b, b, c + b * b)), f, "l00 double, l10 double, l11 double, x array<double>, g array<double>, residual double", "m", keep=["p_partkey"], width=2)
    return out.select("p_partkey", "l00", "l10", "l11", *_spread(out, "x", 2, "x"), *_spread(out, "g", 2, "g"), "residual")
