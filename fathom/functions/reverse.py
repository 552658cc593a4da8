"""Reverse-mode derivatives: formulas over Vars leave a tape, and one pass back gives the slopes by all variables.

Values are Duals of columns, so a pass over variables that carry a direction gives second derivatives as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.symbolic import Dual, Number, Symbol, _slope, _Tree


def _dual(e: _Tree, x: Dual) -> Dual:
    """A tree of one symbol at a Dual."""
    if isinstance(e, Number):
        return Dual(float(e.value))
    if isinstance(e, Symbol):
        return x
    a = [_dual(y, x) for y in e.args]
    if e.kind == "+":
        return a[0] + a[1]
    if e.kind == "*":
        return a[0] * a[1]
    if e.kind == "^":
        n = float(e.args[1].value)
        return 1 / a[0] if n == -1 else a[0] * a[0] if n == 2 else a[0] ** n
    return a[0].apply(e.kind)


class Tape:
    def __init__(self):
        self.nodes: list[Var] = []

    def var(self, value, direction=0.0) -> Var:
        return Var(self, Dual(value, direction), [])

    def backward(self, result: Var) -> dict[int, Dual]:
        """Slopes of result by every Var on the tape, by their numbers."""
        slopes = {result.number: Dual(1.0)}
        for node in reversed(self.nodes[: result.number + 1]):
            own = slopes.get(node.number)
            if own is None:
                continue
            for parent, local in node.parents:
                part = own * local
                slopes[parent.number] = slopes[parent.number] + part if parent.number in slopes else part
        return slopes


class Var:
    def __init__(self, tape: Tape, value: Dual, parents: list[tuple[Var, Dual]]):
        self.tape, self.dual, self.parents, self.number = tape, value, parents, len(tape.nodes)
        tape.nodes.append(self)

    @property
    def value(self) -> Column:
        return self.dual.value

    def _of(self, o) -> Var:
        return o if isinstance(o, Var) else Var(self.tape, Dual.of(o), [])

    def _new(self, value: Dual, *parents: tuple[Var, Dual]) -> Var:
        return Var(self.tape, value, list(parents))

    def __add__(self, o):
        o = self._of(o)
        return self._new(self.dual + o.dual, (self, Dual(1.0)), (o, Dual(1.0)))

    __radd__ = __add__

    def __neg__(self):
        return self._new(-self.dual, (self, Dual(-1.0)))

    def __sub__(self, o):
        return self + -self._of(o)

    def __rsub__(self, o):
        return self._of(o) + -self

    def __mul__(self, o):
        o = self._of(o)
        return self._new(self.dual * o.dual, (self, o.dual), (o, self.dual))

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = self._of(o)
        q = self.dual / o.dual
        return self._new(q, (self, 1 / o.dual), (o, -q / o.dual))

    def __rtruediv__(self, o):
        return self._of(o) / self

    def __pow__(self, n: float):
        return self._new(self.dual**n, (self, n * self.dual ** (n - 1)))

    def apply(self, name: str) -> Var:
        """sin, cos, tan, exp, log, sqrt, tanh, sinh, cosh, atan, asin, acos or abs."""
        return self._new(self.dual.apply(name), (self, _dual(_slope(name, Symbol("x")), self.dual)))

    def sigmoid(self) -> Var:
        return 1 / (1 + (-self).apply("exp"))

    def relu(self) -> Var:
        on = F.when(self.value > 0, 1.0).otherwise(0.0)
        return self._new(self.dual * Dual(on), (self, Dual(on)))


def gradient(f: Callable[..., Var], *columns: Column) -> list[Column]:
    tape = Tape()
    xs = [tape.var(c) for c in columns]
    slopes = tape.backward(f(*xs))
    return [slopes.get(x.number, Dual(0.0)).value for x in xs]


def jacobian(f: Callable[..., list[Var]], *columns: Column) -> list[list[Column]]:
    tape = Tape()
    xs = [tape.var(c) for c in columns]
    return [[slopes.get(x.number, Dual(0.0)).value for x in xs] for slopes in map(tape.backward, f(*xs))]


def hessian(f: Callable[..., Var], *columns: Column) -> list[list[Column]]:
    """Row i by a pass back over variables that move along variable i."""
    out = []
    for i in range(len(columns)):
        tape = Tape()
        xs = [tape.var(c, float(i == k)) for k, c in enumerate(columns)]
        slopes = tape.backward(f(*xs))
        out.append([slopes.get(x.number, Dual(0.0)).slope for x in xs])
    return out
