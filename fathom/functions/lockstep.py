"""Instances in lockstep: one numpy call serves a stack of them, components on the first axis and instances on the last.

Each instance takes the steps that it would take alone, and none depends on its neighbours; those that are done leave the
stack. A function of a stack is f(x, rows): points, and the numbers of the instances that they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.session import ship, spread

Stack = np.ndarray


class Rows:
    """Numbers of n instances as attributes, instances on the last axis."""

    def __init__(self, n: int, numbers: dict[str, Stack] | None = None):
        self._n, self._numbers = n, numbers or {}

    def __len__(self) -> int:
        return self._n

    def __getattr__(self, name: str) -> Stack:
        try:
            return self.__dict__["_numbers"][name]
        except KeyError:
            raise AttributeError(name) from None

    def take(self, at: Stack) -> Rows:
        n = int(at.sum()) if at.dtype == bool else len(at)
        return Rows(n, {k: v[..., at] for k, v in self._numbers.items()})

    def plus(self, **numbers: Stack) -> Rows:
        return Rows(self._n, self._numbers | numbers)


def together(df: DataFrame, id: str, f: Callable[[Rows], list[Stack]], out: str = "y", block: int = 4096) -> DataFrame:
    """(id, out array<double>): f of the other columns, all numbers, of up to `block` rows at once, rows spread over all cores.

    A row with a number that is null or not finite gives null.
    """
    ship(df.sparkSession)
    kind, names = df.schema[id].dataType.simpleString(), [c for c in df.columns if c != id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                x = {c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names}
                fine = np.isfinite(np.array([*x.values()])).all(0) if names else np.ones(b.num_rows, bool)
                n, parts = int(fine.sum()), []
                if n:
                    parts = np.stack([np.broadcast_to(np.asarray(v, float), (n,)) for v in f(Rows(n, {c: v[fine] for c, v in x.items()}))], 1)
                offsets = np.concatenate([[0], np.cumsum(fine)]) * (parts.shape[1] if n else 0)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~fine, False)), pa.array(np.ravel(parts), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(id), lists], names=[id, out])

    return spread(df.select(id, *names), id).mapInArrow(run, f"`{id}` {kind}, `{out}` array<double>")


def alone(f):
    """A function of one point as a function of stacks."""
    if isinstance(f, list):
        return [alone(g) for g in f]
    return (lambda x, rows: np.stack([np.asarray(f(c), float) for c in x.T], -1)) if callable(f) else f


def both(method):
    """A method on stacks, f, x (n, k), .., rows=; without rows it takes one instance: x (n), and functions of x alone."""

    @wraps(method)
    def run(f, x, *args, rows: Rows | None = None, **named):
        if rows is not None:
            return method(f, np.array(x, float), *args, rows=rows, **named)
        x, told = method(alone(f), np.array(x, float)[:, None], *map(alone, args), rows=Rows(1), **{k: alone(v) for k, v in named.items()})
        return x[:, 0], {k: v[0].item() for k, v in told.items()}

    return run


def gradient(f, x: Stack, rows: Rows) -> Stack:
    """Central differences."""
    h, out = np.cbrt(np.finfo(float).eps) * np.maximum(1, np.abs(x)), np.empty_like(x)
    for i, s in enumerate(h):
        up, down = x.copy(), x.copy()
        up[i] += s
        down[i] -= s
        out[i] = (f(up, rows) - f(down, rows)) / (2 * s)
    return out


def size(x: Stack) -> Stack:
    return np.sqrt((x * x).sum(0))


def until(rounds: int, state: dict[str, Stack], rows: Rows, *turns) -> tuple[Stack, dict[str, Stack]]:
    """Rounds of turns over state, of which "x" is the answer. A turn, turn(state, rows), changes the state and returns which
    instances leave with the x they have, and which of them converged."""
    n = state["x"].shape[-1]
    live, x = np.arange(n), state["x"].copy()
    told = {"rounds": np.full(n, rounds), "converged": np.zeros(n, bool)}
    for k in range(rounds):
        for turn in turns:
            gone, good = turn(state, rows)
            if gone.any():
                at = live[gone]
                x[..., at] = state["x"][..., gone]
                told["rounds"][at], told["converged"][at] = k, good[gone]
                live, rows = live[~gone], rows.take(~gone)
                for name in state:
                    state[name] = state[name][..., ~gone]
            if not len(live):
                return x, told
    x[..., live] = state["x"]
    return x, told


def jacobian(g: Callable[[Stack], Stack], x: Stack, at: Stack) -> Stack:
    """(n, n, ..): slopes of g, which is `at` at x, by each component of x (n, ..)."""
    e, out = 1e-7 * np.maximum(1, np.abs(x)), np.empty((len(x), *x.shape))
    for j, s in enumerate(e):
        y = x.copy()
        y[j] += s
        out[:, j] = (g(y) - at) / s
    return out


def solve(m: Stack, b: Stack) -> Stack:
    """m (n, n, ..) @ x = b (n, ..): elimination with partial pivots, for few unknowns of many systems."""
    if b.ndim == 1:
        return np.linalg.solve(m, b)
    m, b, n = m.copy(), b.copy(), len(b)
    for j in range(n):
        for i in range(j + 1, n):
            swap = np.abs(m[i, j]) > np.abs(m[j, j])
            if swap.any():
                m[j], m[i] = np.where(swap, m[i], m[j]), np.where(swap, m[j], m[i])
                b[j], b[i] = np.where(swap, b[i], b[j]), np.where(swap, b[j], b[i])
        for i in range(j + 1, n):
            f = m[i, j] / m[j, j]
            m[i, j + 1 :] -= f * m[j, j + 1 :]
            b[i] -= f * b[j]
    for j in reversed(range(n)):
        for i in range(j + 1, n):
            b[j] -= m[j, i] * b[i]
        b[j] /= m[j, j]
    return b
