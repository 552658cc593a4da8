"""Small dense matrices, one a row: solves, decompositions, eigenvalues, norms.

A matrix is an array<double> column in row order with a fixed number of columns. Kernels work on stacks: all matrices of
one shape in an Arrow batch go through a kernel at once, so nothing is called row by row. A matrix that a kernel cannot
take (singular, not positive definite, wrong size, null or non-finite) gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import ship, spread

Stack = np.ndarray
EPS = float(np.finfo(float).eps)


def each(df: DataFrame, f: Callable[..., dict[str, np.ndarray]], fields: str, *columns: str, width: int | None = None, keep: list[str]) -> DataFrame:
    """keep and the fields that f makes of stacks: one (k, rows, width) stack a column, of vectors a
    (k, length) stack from the second column on. f returns arrays of k first; an
    entry that is not finite becomes null."""
    ship(df.sparkSession)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    names = [x.strip().split(" ")[0] for x in fields.split(",")]

    single = {x.strip().split(" ")[0] for x in fields.split(",") if x.strip().endswith(" double")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            raw = [b.column(len(keep) + i) for i in range(len(columns))]
            starts, values = [c.offsets.to_numpy()[:-1] for c in raw], [c.values.to_numpy(zero_copy_only=False) for c in raw]
            # a null has length -1
            lengths = np.stack([np.where(c.is_valid().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()), -1) for c in raw], 1)
            made: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in names}
            for shape in np.unique(lengths, axis=0).tolist() if n else ():
                w = width or int(round(max(shape[0], 0) ** 0.5))
                if min(shape) < 0 or not shape[0] or shape[0] % w:
                    continue
                at = np.flatnonzero((lengths == shape).all(1))
                stacks = [v[s[at][:, None] + np.arange(k)].astype(float) for v, s, k in zip(values, starts, shape, strict=True)]
                fine = np.logical_and.reduce([np.isfinite(s).all(1) for s in stacks])
                at = at[fine]
                if not len(at):
                    continue
                stacks = [s[fine].reshape(len(at), -1, w) if i == 0 or s.shape[1] > w and s.shape[1] % w == 0 else s[fine] for i, s in enumerate(stacks)]
                for k, v in f(*stacks).items():
                    flat = np.asarray(v, float).reshape(len(at), -1)
                    good = np.isfinite(flat).all(1)
                    made[k].append((at[good], flat[good]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(_scalars(n, made[k]) if k in single else _lists(n, made[k]) for k in names)], names=[*keep, *names])

    x = df.select(*(F.col(c) for c in keep), *(F.col(c).cast("array<double>") for c in columns))
    return (spread(x, *keep) if keep else x).mapInArrow(run, ", ".join([*kinds, fields]))


def _scalars(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    out, none = np.zeros(n), np.ones(n, bool)
    for at, x in parts:
        out[at], none[at] = x[:, 0], False
    return pa.array(out, pa.float64(), mask=none)


def _lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    lengths, none = np.zeros(n, np.int64), np.ones(n, bool)
    for at, x in parts:
        lengths[at], none[at] = x.shape[1], False
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.empty(offsets[-1])
    for at, x in parts:
        values[offsets[at][:, None] + np.arange(x.shape[1])] = x
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), pa.array(values, pa.float64()))


def _guarded(f: Callable[[Stack], Stack], a: Stack, shape: tuple) -> Stack:
    """f of a stack; where it fails, of each matrix by itself, with NaN for those that fail."""
    try:
        return f(a)
    except np.linalg.LinAlgError:
        out = np.full((len(a), *shape), np.nan)
        for i in range(len(a)):
            try:
                out[i] = f(a[i : i + 1])[0]
            except np.linalg.LinAlgError:
                pass
        return out


def _square(a: Stack) -> int:
    if a.shape[1] != a.shape[2]:
        raise ValueError("the matrices are not square")
    return a.shape[1]


def lu(a: Stack) -> tuple[Stack, Stack, Stack, np.ndarray]:
    """(p, l, u, sign): rows p of a are l @ u, with partial pivoting; sign: that of the permutation."""
    n = _square(a)
    u, l, at = a.copy(), np.broadcast_to(np.eye(n), a.shape).copy(), np.arange(len(a))
    p, sign = np.tile(np.arange(n), (len(a), 1)), np.ones(len(a))
    for k in range(n):
        r = np.abs(u[:, k:, k]).argmax(1) + k
        sign = np.where(r != k, -sign, sign)
        for x, upto in ((u, n), (l, k), (p[:, :, None], 1)):
            x[at, k, :upto], x[at, r, :upto] = x[at, r, :upto].copy(), x[at, k, :upto].copy()
        d = u[:, k, k]
        f = np.divide(u[:, k + 1 :, k], d[:, None], out=np.zeros((len(a), n - k - 1)), where=d[:, None] != 0)
        l[:, k + 1 :, k] = f
        u[:, k + 1 :, k:] -= f[:, :, None] * u[:, k : k + 1, k:]
        u[:, k + 1 :, k] = 0
    return p, l, u, sign


def determinant(a: Stack) -> np.ndarray:
    _, _, u, sign = lu(a)
    return sign * np.diagonal(u, axis1=1, axis2=2).prod(1)


def singular(a: Stack) -> np.ndarray:
    """Which matrices have a pivot that is nothing beside their largest entry."""
    u = np.abs(np.diagonal(lu(a)[2], axis1=1, axis2=2)).min(1)
    return u <= EPS * a.shape[1] * np.abs(a).max((1, 2))


def solve(a: Stack, b: Stack) -> Stack:
    """x of a @ x = b; b: vectors or matrices of right sides."""
    b = b[:, :, None] if b.ndim == 2 else b
    bad = singular(a)
    x = np.linalg.solve(np.where(bad[:, None, None], np.eye(a.shape[1]), a), b)
    x[bad] = np.nan
    return x


def inverse(a: Stack) -> Stack:
    return solve(a, np.broadcast_to(np.eye(_square(a)), a.shape))


def qr(a: Stack) -> tuple[Stack, Stack]:
    """Orthonormal columns and an upper triangle with a diagonal that is not negative."""
    q, r = np.linalg.qr(a)
    s = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
    return q * s[:, None, :], r * s[:, :, None]


def qr_pivoted(a: Stack) -> tuple[Stack, Stack, np.ndarray]:
    """(q, r, p): columns p of a are q @ r, the longest remaining column first."""
    k, m, n = a.shape
    rest, p, at = a.copy(), np.tile(np.arange(n), (k, 1)), np.arange(k)
    for j in range(min(m, n)):
        c = (rest[:, :, j:] ** 2).sum(1).argmax(1) + j
        for x in (rest, p[:, None, :]):
            x[at, :, j], x[at, :, c] = x[at, :, c].copy(), x[at, :, j].copy()
        d = (rest[:, :, j] ** 2).sum(1)
        f = np.einsum("km,kmn->kn", rest[:, :, j], rest[:, :, j + 1 :]) / np.where(d > 0, d, 1)[:, None]
        rest[:, :, j + 1 :] -= rest[:, :, j : j + 1] * f[:, None, :]
    q, r = qr(np.take_along_axis(a, p[:, None, :], 2))
    return q, r, p


def cholesky(a: Stack) -> Stack:
    """Lower triangles; NaN where a matrix is not symmetric and positive definite."""
    n = _square(a)
    out = _guarded(np.linalg.cholesky, a, (n, n))
    out[np.abs(a - a.transpose(0, 2, 1)).max((1, 2)) > 1e-10 * np.abs(a).max((1, 2))] = np.nan
    return out


def cholesky_solve(a: Stack, b: Stack) -> Stack:
    l = cholesky(a)
    bad = ~np.isfinite(l).all((1, 2))
    l = np.where(bad[:, None, None], np.eye(a.shape[1]), l)
    x = np.linalg.solve(l.transpose(0, 2, 1), np.linalg.solve(l, b[:, :, None] if b.ndim == 2 else b))
    x[bad] = np.nan
    return x


def svd(a: Stack) -> tuple[Stack, Stack, Stack]:
    return np.linalg.svd(a, full_matrices=False)


def rank(a: Stack, tol: float | None = None) -> np.ndarray:
    s = np.linalg.svd(a, compute_uv=False)
    return (s > (max(a.shape[1:]) * EPS * s[:, :1] if tol is None else tol)).sum(1).astype(float)


def pseudoinverse(a: Stack) -> Stack:
    return np.linalg.pinv(a)


def least_squares(a: Stack, b: Stack) -> Stack:
    return pseudoinverse(a) @ (b[:, :, None] if b.ndim == 2 else b)


def condition_2(a: Stack) -> np.ndarray:
    s = np.linalg.svd(a, compute_uv=False)
    return np.divide(s[:, 0], s[:, -1], out=np.full(len(a), np.inf), where=s[:, -1] > 0)


def condition_1(a: Stack) -> np.ndarray:
    return np.abs(a).sum(1).max(1) * np.abs(inverse(a)).sum(1).max(1)


def symmetric_eigen(a: Stack) -> tuple[Stack, Stack]:
    """Eigenvalues ascending and vectors in columns; NaN where a matrix is not symmetric."""
    w, v = np.linalg.eigh((a + a.transpose(0, 2, 1)) / 2)
    bad = np.abs(a - a.transpose(0, 2, 1)).max((1, 2)) > 1e-10 * np.maximum(np.abs(a).max((1, 2)), 1e-300)
    w[bad], v[bad] = np.nan, np.nan
    return w, v


def eigenvalues(a: Stack) -> Stack:
    """(re, im) of all eigenvalues in order of their real, then imaginary parts."""
    w = np.linalg.eigvals(a).astype(complex)
    w = np.take_along_axis(w, np.lexsort((w.imag, w.real), axis=1), 1)
    return np.stack([w.real, w.imag], 2)


def generalised_eigen(a: Stack, b: Stack) -> tuple[Stack, Stack]:
    """w and v of a @ v = b @ v * w for symmetric a and positive definite b, through the Cholesky factor of b."""
    l = cholesky(b)
    bad = ~np.isfinite(l).all((1, 2))
    l = np.where(bad[:, None, None], np.eye(a.shape[1]), l)
    c = np.linalg.solve(l, np.linalg.solve(l, a.transpose(0, 2, 1)).transpose(0, 2, 1))
    w, v = symmetric_eigen((c + c.transpose(0, 2, 1)) / 2)
    v = np.linalg.solve(l.transpose(0, 2, 1), v)
    w[bad] = np.nan
    return w, v


def schur(a: Stack) -> tuple[Stack, Stack]:
    """Orthogonal q and quasi-triangular t with a = q @ t @ q.T: eigenvectors, or planes of complex pairs, are split off."""
    n = _square(a)
    q, t = np.broadcast_to(np.eye(n), a.shape).copy(), a.copy()
    for i in range(len(a)):
        k = 0
        while k < n:
            w, v = np.linalg.eig(t[i, k:, k:])
            j = int(np.abs(w.imag).argmin())
            real = abs(w[j].imag) <= 1e-12 * max(1e-300, np.abs(w).max())
            plane = v[:, [j]].real if real else np.stack([v[:, j].real, v[:, j].imag], 1)
            turn = np.eye(n)
            turn[k:, k:] = np.linalg.qr(plane, mode="complete")[0]
            t[i], q[i] = turn.T @ t[i] @ turn, q[i] @ turn
            t[i, k + plane.shape[1] :, k : k + plane.shape[1]] = 0
            k += plane.shape[1]
    return q, t


def inverse_iteration(a: Stack, shift: float, rounds: int = 100) -> tuple[np.ndarray, Stack]:
    """The eigenvalue nearest to shift and its vector."""
    n = _square(a)
    x = np.ones((len(a), n, 1)) + np.arange(n)[None, :, None] / n
    m = a - shift * (1 + 1e-10) * np.eye(n) - 1e-12 * np.eye(n)
    for _ in range(rounds):
        x = np.linalg.solve(m, x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x.transpose(0, 2, 1) @ a @ x)[:, 0, 0], x[:, :, 0]


def rayleigh_quotient_iteration(a: Stack, x: Stack, rounds: int = 30) -> tuple[np.ndarray, Stack]:
    """An eigenvalue and vector near the start x, converging cubically for symmetric matrices."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.einsum("ki,kij,kj->k", x, a, x)
    at = np.arange(len(a))
    for _ in range(rounds):
        b, v = a[at], x[at]
        m = b - w[at, None, None] * np.eye(a.shape[1])
        near = singular(m) | (np.abs(np.einsum("kij,kj->ki", m, v)).max(1) < 1e-13 * np.abs(b).max((1, 2)))
        # those that are near would stay as they are
        at, b, m, v = at[~near], b[~near], m[~near], v[~near]
        if not len(at):
            break
        y = np.linalg.solve(m, v[:, :, None])[:, :, 0]
        x[at] = v = y / np.linalg.norm(y, axis=1, keepdims=True)
        w[at] = np.einsum("ki,kij,kj->k", v, b, v)
    return w, x


def simultaneous_iteration(a: Stack, k: int, rounds: int = 500) -> tuple[Stack, Stack]:
    """The k eigenvalues of largest modulus of symmetric matrices, largest first, and their vectors."""
    n = _square(a)
    x, _ = qr(np.broadcast_to(np.eye(n)[:, :k] + 1.0 / (1 + np.arange(n)[:, None] + np.arange(k)), (len(a), n, k)))
    if k == 1:
        x = _power(a, x[:, :, 0], rounds)[:, :, None]
    else:
        for _ in range(rounds):
            x, _ = qr(a @ x)
    w, v = np.linalg.eigh(x.transpose(0, 2, 1) @ a @ x)
    by = np.argsort(-np.abs(w), axis=1)
    return np.take_along_axis(w, by, 1), x @ np.take_along_axis(v, by[:, None, :], 2)


def _power(a: Stack, x: Stack, rounds: int) -> Stack:
    """Rounds of x = a @ x over its length, matrices on the last axis; nothing becomes the first unit vector, as in qr."""
    a, x = np.ascontiguousarray(a.transpose(1, 2, 0)), np.ascontiguousarray(x.T)
    for _ in range(rounds):
        x = (a * x).sum(1)
        size = np.sqrt((x * x).sum(0))
        if not size.all():
            x[0], size = np.where(size > 0, x[0], 1.0), np.where(size > 0, size, 1.0)
        x /= size
    return x.T


def eigen_residuals(a: Stack, w: Stack, v: Stack) -> dict[str, np.ndarray]:
    """How far pairs are from a @ v = v * w, from orthogonality, and from v @ w @ v.T = a."""
    n = a.shape[1]
    return {
        "pairs": np.linalg.norm(a @ v - v * w[:, None, :], axis=1).max(1),
        "orthogonality": np.abs(v.transpose(0, 2, 1) @ v - np.eye(n)).max((1, 2)),
        "spectrum": np.abs((v * w[:, None, :]) @ v.transpose(0, 2, 1) - a).max((1, 2)),
    }


def exponential(a: Stack) -> Stack:
    """exp(a) by a Taylor polynomial of a scaled matrix, squared again."""
    n = _square(a)
    s = max(0, int(np.ceil(np.log2(max(1e-300, float(np.abs(a).sum(2).max(initial=0)))))) + 6)
    x = a / 2.0**s
    out = term = np.broadcast_to(np.eye(n), a.shape)
    for k in range(1, 13):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def quadratic_form(a: Stack, x: Stack) -> np.ndarray:
    return np.einsum("ki,kij,kj->k", x, a, x)


def inner(a: Stack, b: Stack) -> np.ndarray:
    """Sum of products of equal entries: the trace of a.T @ b."""
    return (a * b).sum((1, 2))


def psd_report(a: Stack) -> dict[str, np.ndarray]:
    """Least and greatest eigenvalue, and how many are below nothing."""
    w, _ = symmetric_eigen(a)
    return {"least": w[:, 0], "greatest": w[:, -1], "below": (w < -1e-10 * np.abs(w).max(1)[:, None]).sum(1).astype(float)}


def krylov(a: Stack, b: Stack, method: str, rounds: int = 200, tol: float = 1e-12) -> Stack:
    """a @ x = b by "gmres", "bicgstab" or "minres" (symmetric); gmres and minres by the Arnoldi basis, least residual."""
    return (_bicgstab if method == "bicgstab" else _arnoldi_solve)(a, b, rounds, tol)


def _dot(a: Stack, b: Stack) -> np.ndarray:
    return (a * b).sum(1)


def _times(a: Stack, x: Stack) -> Stack:
    return (a @ x[:, :, None])[:, :, 0]


def _orthogonalised(w: Stack, v: list[Stack]) -> tuple[Stack, np.ndarray]:
    """w without its parts along v, taken out twice, and these parts (k, len(v))."""
    parts = np.zeros((len(w), len(v)))
    for _ in range(2):
        for i, x in enumerate(v):
            c = _dot(x, w)
            parts[:, i] += c
            w = w - c[:, None] * x
    return w, parts


def _arnoldi_solve(a: Stack, b: Stack, rounds: int, tol: float) -> Stack:
    n, out, beta = b.shape[1], np.zeros_like(b, dtype=float), np.linalg.norm(b, axis=1)
    at = np.flatnonzero(beta > 0)
    most = min(rounds, n)
    a, beta, h, v = a[at], beta[at], np.zeros((len(at), most + 1, most)), [b[at] / beta[at, None]]
    for j in range(most):
        w, h[:, : j + 1, j] = _orthogonalised(_times(a, v[j]), v)
        h[:, j + 1, j] = size = np.linalg.norm(w, axis=1)
        full = (size <= tol * beta) if j + 1 < most else np.ones(len(at), bool)
        if full.any():
            e = np.zeros((int(full.sum()), j + 2, 1))
            e[:, 0, 0] = beta[full]
            y = np.linalg.pinv(h[full, : j + 2, : j + 1], rcond=EPS * (j + 2)) @ e
            out[at[full]] = (np.stack([x[full] for x in v], 2) @ y)[:, :, 0]
            at, a, beta, h, w, size, v = at[~full], a[~full], beta[~full], h[~full], w[~full], size[~full], [x[~full] for x in v]
        if not len(at):
            break
        v.append(w / size[:, None])
    return out


def _bicgstab(a: Stack, b: Stack, rounds: int, tol: float) -> Stack:
    out, at = np.zeros_like(b, dtype=float), np.arange(len(b))
    r = b.astype(float)
    x, shadow, p, rho, size = np.zeros_like(r), r, r, _dot(r, r), np.linalg.norm(r, axis=1)
    stop = np.zeros(len(b), bool)
    for _ in range(rounds):
        stop = stop | (np.linalg.norm(r, axis=1) <= tol * size)
        if stop.any():
            out[at[stop]] = x[stop]
            at, a, x, r, shadow, p, rho, size = (y[~stop] for y in (at, a, x, r, shadow, p, rho, size))
        if not len(at):
            return out
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            q = _times(a, p)
            alpha = rho / _dot(shadow, q)
            s = r - alpha[:, None] * q
            t = _times(a, s)
            tt = _dot(t, t)
            omega = np.where(tt != 0, _dot(t, s) / np.where(tt != 0, tt, 1.0), 0.0)
            x = x + alpha[:, None] * p + omega[:, None] * s
            r = s - omega[:, None] * t
            stop = omega == 0
            new = _dot(shadow, r)
            p = r + (new / rho * alpha / np.where(stop, 1.0, omega))[:, None] * (p - omega[:, None] * q)
            rho = new
    out[at] = x
    return out


def incomplete_lu(a: Stack) -> Stack:
    """L and U in one matrix, without entries where a has none."""
    out, held = a.copy(), a != 0
    for k in range(a.shape[1]):
        for i in range(k + 1, a.shape[1]):
            f = np.where(held[:, i, k], np.divide(out[:, i, k], out[:, k, k], out=np.zeros(len(a)), where=out[:, k, k] != 0), 0)
            out[:, i, k] = f
            out[:, i, k + 1 :] -= np.where(held[:, i, k + 1 :], f[:, None] * out[:, k, k + 1 :], 0)
    return out


def lanczos(a: Stack, steps: int) -> Stack:
    """Eigenvalues, ascending, of the tridiagonal matrix after some Lanczos steps with full orthogonalisation."""
    n = _square(a)
    out, at = np.full((len(a), steps), np.nan), np.arange(len(a))
    first = np.ones(n) / n**0.5 + np.arange(n) / (10.0 * n)
    v, t = [np.broadcast_to(first / np.linalg.norm(first), (len(a), n))], np.zeros((len(a), steps, steps))
    for j in range(min(steps, n)):
        w = _times(a, v[j])
        t[:, j, j] = _dot(v[j], w)
        w, _ = _orthogonalised(w, v)
        beta = np.linalg.norm(w, axis=1)
        last = j + 1 == steps
        full = np.ones(len(at), bool) if last else beta < 1e-13 * np.maximum(1e-300, np.abs(a).max((1, 2)))
        out[at[full], : j + 1] = np.linalg.eigvalsh(t[full, : j + 1, : j + 1])
        at, a, t, w, beta, v = at[~full], a[~full], t[~full], w[~full], beta[~full], [x[~full] for x in v]
        if not len(at):
            return out
        t[:, j, j + 1] = t[:, j + 1, j] = beta
        v.append(w / beta[:, None])
    if len(at):
        out[at] = np.linalg.eigvalsh(t)
    return out
