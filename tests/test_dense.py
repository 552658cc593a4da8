"""Dense kernels against their defining equations."""

import sys

import numpy as np
import pytest

from fathom.functions import dense


def stack(n, k=5, seed=0):
    return np.random.default_rng(seed).normal(size=(k, n, n))


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_factors_give_the_matrix_back(n):
    a = stack(n)
    p, l, u, sign = dense.lu(a)
    assert np.allclose(np.take_along_axis(a, p[:, :, None], 1), l @ u) and np.allclose(np.triu(u), u) and np.allclose(np.tril(l), l)
    assert np.allclose(dense.determinant(a), np.linalg.det(a))
    q, r = dense.qr(a)
    assert np.allclose(q @ r, a) and (np.diagonal(r, axis1=1, axis2=2) >= 0).all()
    q, r, p = dense.qr_pivoted(a)
    assert np.allclose(q @ r, np.take_along_axis(a, p[:, None, :], 2))
    d = np.diagonal(r, axis1=1, axis2=2)
    assert (d[:, :-1] >= d[:, 1:] - 1e-12).all()
    s = a @ a.transpose(0, 2, 1) + np.eye(n)
    c = dense.cholesky(s)
    assert np.allclose(c @ c.transpose(0, 2, 1), s)
    b = stack(n, seed=1)[:, 0]
    assert np.allclose(a @ dense.solve(a, b), b[:, :, None]) and np.allclose(s @ dense.cholesky_solve(s, b), b[:, :, None])
    assert np.allclose(a @ dense.inverse(a), np.eye(n), atol=1e-8)
    w, v = dense.symmetric_eigen(s)
    assert max(x.max() for x in dense.eigen_residuals(s, w, v).values()) < 1e-10
    g, v = dense.generalised_eigen(a + a.transpose(0, 2, 1), s)
    assert np.allclose((a + a.transpose(0, 2, 1)) @ v, s @ v * g[:, None, :])
    for method in ("gmres", "bicgstab"):
        assert np.allclose(np.einsum("kij,kj->ki", s, dense.krylov(s, b, method)), b, atol=1e-6)
    assert np.allclose(dense.lanczos(s, n), w)
    assert np.allclose(dense.simultaneous_iteration(s, 1, 3000)[0][:, 0], w[:, -1], rtol=1e-6)


def test_known_values():
    a = np.array([[[2.0, -1, 0], [-1, 2, -1], [0, -1, 2]]])
    assert np.allclose(dense.symmetric_eigen(a)[0], [[2 - 2**0.5, 2, 2 + 2**0.5]])
    assert np.allclose(dense.inverse_iteration(a, 2.1)[0], 2) and np.allclose(dense.rayleigh_quotient_iteration(a, np.array([[1.0, 0, -0.9]]))[0], 2)
    q, x = dense.schur(np.array([[[4.0, 1], [2, 3]], [[1.0, 5], [0, 1]]]))
    assert np.allclose(q @ x @ q.transpose(0, 2, 1), [[[4.0, 1], [2, 3]], [[1.0, 5], [0, 1]]]) and np.allclose(sorted(np.diagonal(x[0])), [2, 5])
    turn = np.array([[[0.0, -np.pi / 2], [np.pi / 2, 0]]])
    assert np.allclose(dense.exponential(turn), [[[0, -1], [1, 0]]]) and np.allclose(dense.eigenvalues(turn), [[[0, -np.pi / 2], [0, np.pi / 2]]])
    assert np.isnan(dense.cholesky(np.array([[[1.0, 2], [2, 1]]]))).all() and np.isnan(dense.solve(np.array([[[1.0, 2], [2, 4]]]), np.array([[1.0, 1]]))).all()
    assert dense.rank(np.array([[[1.0, 2], [2, 4]]]))[0] == 1 and np.isnan(dense.symmetric_eigen(np.array([[[1.0, 5], [0, 1]]]))[0]).all()


def test_rows_that_no_kernel_takes_are_null(spark):
    rows = [(1, [1.0, 0.0, 0.0, 1.0]), (2, None), (3, [1.0, None, 0.0, 1.0]), (4, [float("nan"), 0.0, 0.0, 1.0]), (5, [1.0, 2.0, 2.0, 4.0]), (6, [1.0, 2.0]), (7, [])]
    df = spark.createDataFrame(rows, "id long, m array<double>")
    got = {r.id: (r.det, r.inv) for r in dense.each(df, lambda m: {"det": dense.determinant(m) if m.shape[1] == 2 else np.full(len(m), np.nan), "inv": dense.inverse(m) if m.shape[1] == 2 else np.full((len(m), 1), np.nan)}, "det double, inv array<double>", "m", keep=["id"], width=2).collect()}
    assert got[1] == (1.0, [1.0, 0.0, 0.0, 1.0]) and got[5] == (0.0, None) and all(got[k] == (None, None) for k in (2, 3, 4, 6, 7))


def test_kernels_take_whole_stacks():
    """None goes matrix by matrix: the same few calls serve any number of them."""
    a, b = stack(3, 4000), stack(3, 4000, 1)[:, 0]
    s = a @ a.transpose(0, 2, 1) + np.eye(3)
    for f in (lambda k: dense.krylov(s[:k], b[:k], "gmres"), lambda k: dense.krylov(s[:k], b[:k], "bicgstab"), lambda k: dense.lanczos(s[:k], 3)):
        calls = []
        for k in (1000, 4000):
            n, before = [0], sys.getprofile()
            sys.setprofile(lambda frame, event, arg, n=n: n.__setitem__(0, n[0] + (event == "call")))
            try:
                f(k)
            finally:
                sys.setprofile(before)
            calls.append(n[0])
        assert calls[1] < 1.5 * calls[0] < 3000
    assert np.allclose(dense.krylov(s, b, "gmres"), dense.solve(s, b)[:, :, 0]) and np.allclose(dense.lanczos(s, 3), dense.symmetric_eigen(s)[0])


def test_stacks_with_early_ends():
    """Matrices whose Krylov space ends early, and right sides of nothing, among others."""
    a, b = stack(3, 6) + 4 * np.eye(3), stack(3, 6, 1)[:, 0]
    a[1], a[4], b[2] = 2 * np.eye(3), np.diag([1.0, 1.0, 5.0]), 0
    assert np.allclose(np.einsum("kij,kj->ki", a, dense.krylov(a, b, "gmres")), b) and not dense.krylov(a, b, "gmres")[2].any()
    w = dense.lanczos((a + a.transpose(0, 2, 1)) / 2, 3)
    assert np.isnan(w[1]).tolist() == [False, True, True] and w[1, 0] == pytest.approx(2) and np.isfinite(w[0]).all()
    low = np.array([[[-3.0, 0], [0, 1]], [[0.0, 0], [0, 0]]])
    assert np.allclose(dense.simultaneous_iteration(low, 1)[0][:, 0], [-3, 0])
