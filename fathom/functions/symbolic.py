"""Expressions as small trees: exact derivatives, simplification, and a column or a number for a value.

A tree is a number (Fraction), a Symbol, or an Op over trees. `column` turns a tree into a Spark column, so the derivative
of a model stays in generated code; `Dual` carries (value, slope) columns through any formula written with its operators.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.errors import need

_UNARY = {"sin": math.sin, "cos": math.cos, "exp": math.exp, "log": math.log, "tanh": math.tanh, "sqrt": math.sqrt, "atan": math.atan}
_UNARY |= {"tan": math.tan, "sinh": math.sinh, "cosh": math.cosh, "asin": math.asin, "acos": math.acos, "abs": abs, "signum": lambda x: float((x > 0) - (x < 0))}


class _Tree:
    def __add__(self, o):
        return Op("+", (self, lift(o)))

    __radd__ = __add__

    def __mul__(self, o):
        return Op("*", (self, lift(o)))

    __rmul__ = __mul__

    def __neg__(self):
        return Op("*", (lift(-1), self))

    def __sub__(self, o):
        return self + -lift(o)

    def __rsub__(self, o):
        return lift(o) + -self

    def __truediv__(self, o):
        return self * Op("^", (lift(o), lift(-1)))

    def __rtruediv__(self, o):
        return lift(o) / self

    def __pow__(self, o):
        return Op("^", (self, lift(o)))


@dataclass(frozen=True)
class Number(_Tree):
    value: Fraction


@dataclass(frozen=True)
class Symbol(_Tree):
    name: str


@dataclass(frozen=True)
class Op(_Tree):
    kind: str
    args: tuple


def lift(x) -> _Tree:
    return x if isinstance(x, _Tree) else Number(Fraction(x))


def call(name: str, x) -> Op:
    need(name in _UNARY, f"no function {name}")
    return Op(name, (lift(x),))


def _slope(kind: str, u: _Tree) -> _Tree:
    """Derivative of a unary function at u."""
    if kind == "sin":
        return call("cos", u)
    if kind == "cos":
        return -call("sin", u)
    if kind == "exp":
        return call("exp", u)
    if kind == "log":
        return 1 / u
    if kind == "tanh":
        return 1 - call("tanh", u) ** 2
    if kind == "atan":
        return 1 / (1 + u**2)
    if kind == "tan":
        return 1 + call("tan", u) ** 2
    if kind in ("sinh", "cosh"):
        return call("cosh" if kind == "sinh" else "sinh", u)
    if kind in ("asin", "acos"):
        return (1 if kind == "asin" else -1) / call("sqrt", 1 - u**2)
    if kind == "abs":
        return call("signum", u)
    if kind == "signum":
        return lift(0)
    return Fraction(1, 2) / call("sqrt", u)


def differentiate(e: _Tree, name: str) -> _Tree:
    """Exact derivative, simplified."""

    def d(e: _Tree) -> _Tree:
        if isinstance(e, Number):
            return lift(0)
        if isinstance(e, Symbol):
            return lift(int(e.name == name))
        if e.kind == "+":
            return d(e.args[0]) + d(e.args[1])
        if e.kind == "*":
            a, b = e.args
            return d(a) * b + a * d(b)
        if e.kind == "^":
            a, b = e.args
            if isinstance(b, Number):
                return b * a ** (b.value - 1) * d(a)
            return e * (d(b) * call("log", a) + b * d(a) / a)
        return _slope(e.kind, e.args[0]) * d(e.args[0])

    return simplify(d(e))


def simplify(e: _Tree) -> _Tree:
    """Sums and products are flattened, numbers folded and multiplied into sums, equal terms and equal bases gathered, in a fixed order."""
    if not isinstance(e, Op):
        return e
    if e.kind == "+":
        total, terms = Fraction(0), {}
        for x in _flat(e, "+"):
            c, rest = _coefficient(x)
            if rest is None:
                total += c
            else:
                terms[rest] = terms.get(rest, Fraction(0)) + c
        parts = [rest if c == 1 else _product([lift(c), *(_flat(rest, "*"))]) for rest, c in sorted(terms.items(), key=lambda t: repr(t[0])) if c]
        return _chain("+", ([lift(total)] if total or not parts else []) + parts)
    if e.kind == "*":
        return _product(_flat(e, "*"))
    args = tuple(map(simplify, e.args))
    if e.kind == "^":
        a, b = args
        if isinstance(b, Number):
            if b.value == 0:
                return lift(1)
            if b.value == 1:
                return a
            if isinstance(a, Number) and b.value.denominator == 1 and (a.value or b.value > 0):
                return lift(a.value ** int(b.value))
            if isinstance(a, Op) and a.kind == "^" and isinstance(a.args[1], Number) and b.value.denominator == a.args[1].value.denominator == 1:
                return simplify(a.args[0] ** (a.args[1].value * b.value))
    return Op(e.kind, args)


def _flat(e: _Tree, kind: str) -> list[_Tree]:
    out = []
    for x in e.args if isinstance(e, Op) and e.kind == kind else (e,):
        x = simplify(x) if x is not e else x
        out += _flat(x, kind) if isinstance(x, Op) and x.kind == kind and x is not e else [x]
    return out


def _product(factors: list[_Tree]) -> _Tree:
    number, powers = Fraction(1), {}
    for x in factors:
        if isinstance(x, Number):
            number *= x.value
            continue
        base, n = (x.args[0], x.args[1].value) if isinstance(x, Op) and x.kind == "^" and isinstance(x.args[1], Number) else (x, Fraction(1))
        powers[base] = powers.get(base, Fraction(0)) + n
    if number == 0:
        return lift(0)
    parts = [b if n == 1 else Op("^", (b, lift(n))) for b, n in sorted(powers.items(), key=lambda t: repr(t[0])) if n]
    if number != 1 and len(parts) == 1 and isinstance(parts[0], Op) and parts[0].kind == "+":
        return simplify(_chain("+", [lift(number) * x for x in _flat(parts[0], "+")]))
    return _chain("*", ([lift(number)] if number != 1 or not parts else []) + parts)


def _coefficient(x: _Tree) -> tuple[Fraction, _Tree | None]:
    if isinstance(x, Number):
        return x.value, None
    if isinstance(x, Op) and x.kind == "*":
        parts = _flat(x, "*")
        if isinstance(parts[0], Number):
            return parts[0].value, _chain("*", parts[1:]) if len(parts) > 1 else None
    return Fraction(1), x


def _chain(kind: str, parts: list[_Tree]) -> _Tree:
    out = parts[0]
    for p in parts[1:]:
        out = Op(kind, (out, p))
    return out


def substitute(e: _Tree, values: dict[str, object]) -> _Tree:
    if isinstance(e, Symbol):
        return lift(values[e.name]) if e.name in values else e
    return Op(e.kind, tuple(substitute(a, values) for a in e.args)) if isinstance(e, Op) else e


def evaluate(e: _Tree, values: dict[str, float]) -> float:
    if isinstance(e, Number):
        return float(e.value)
    if isinstance(e, Symbol):
        return float(values[e.name])
    a = [evaluate(x, values) for x in e.args]
    return a[0] + a[1] if e.kind == "+" else a[0] * a[1] if e.kind == "*" else a[0] ** a[1] if e.kind == "^" else _UNARY[e.kind](a[0])


def column(e: _Tree, names: dict[str, Column] | None = None) -> Column:
    """The tree as a column; symbols are columns of their own name unless `names` gives others."""
    if isinstance(e, Number):
        return F.lit(float(e.value))
    if isinstance(e, Symbol):
        return (names or {}).get(e.name, F.col(e.name)).cast("double")
    a = [column(x, names) for x in e.args]
    if e.kind == "^":
        n = e.args[1].value if isinstance(e.args[1], Number) else None
        return 1.0 / a[0] if n == -1 else a[0] * a[0] if n == 2 else F.pow(a[0], a[1])
    return a[0] + a[1] if e.kind == "+" else a[0] * a[1] if e.kind == "*" else getattr(F, e.kind)(a[0])


def gradient(e: _Tree, names: list[str]) -> list[Column]:
    return [column(differentiate(e, n)) for n in names]


def jacobian(es: list[_Tree], names: list[str]) -> list[list[Column]]:
    return [gradient(e, names) for e in es]


def hessian(e: _Tree, names: list[str]) -> list[list[Column]]:
    """All second derivatives; equal ones are worked out once."""
    first = [differentiate(e, n) for n in names]
    upper = {(i, j): column(differentiate(first[i], names[j])) for i in range(len(names)) for j in range(i, len(names))}
    return [[upper[min(i, j), max(i, j)] for j in range(len(names))] for i in range(len(names))]


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def laplacian(e: _Tree, names: list[str]) -> Column:
    """The trace of the hessian."""
    return _sum([column(differentiate(differentiate(e, n), n)) for n in names])


def divergence(field: list[_Tree], names: list[str]) -> Column:
    return _sum([column(differentiate(e, n)) for e, n in zip(field, names, strict=True)])


def curl(field: list[_Tree], names: list[str]) -> list[Column]:
    """One column in the plane, three in space."""
    turn = lambda i, j: column(differentiate(field[j], names[i]) - differentiate(field[i], names[j]))
    return [turn(0, 1)] if len(field) == 2 else [turn(1, 2), turn(2, 0), turn(0, 1)]


def gradient_norm(e: _Tree, names: list[str]) -> Column:
    return F.sqrt(_sum([g * g for g in gradient(e, names)]))


def directional(e: _Tree, names: list[str], direction: list) -> Column:
    return _sum([g * d for g, d in zip(gradient(e, names), direction, strict=True)])


def pulled_back(es: list[_Tree], names: list[str], weights: list) -> list[Column]:
    """Weights of the results times the jacobian: the slopes of the weighted sum."""
    return [_sum([column(differentiate(e, n)) * w for e, w in zip(es, weights, strict=True)]) for n in names]


def gradient_error(e: _Tree, names: list[str], h: float = 1e-5) -> Column:
    """The largest distance between exact slopes and central differences."""

    def moved(n: str, by: float) -> Column:
        return column(e, {n: F.col(n).cast("double") + by})

    errors = [F.abs(column(differentiate(e, n)) - (moved(n, h) - moved(n, -h)) / (2 * h)) for n in names]
    return F.greatest(*errors) if len(errors) > 1 else errors[0]


class Dual:
    """A value and its slope as columns: forward-mode derivatives of formulas written over Duals."""

    def __init__(self, value, slope=0.0):
        self.value, self.slope = (x if isinstance(x, Column) else F.lit(float(x)) for x in (value, slope))

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x)

    @staticmethod
    def variable(x) -> Dual:
        return Dual(x, 1.0)

    def __add__(self, o):
        o = Dual.of(o)
        return Dual(self.value + o.value, self.slope + o.slope)

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, o):
        return self + -Dual.of(o)

    def __rsub__(self, o):
        return Dual.of(o) + -self

    def __mul__(self, o):
        o = Dual.of(o)
        return Dual(self.value * o.value, self.slope * o.value + self.value * o.slope)

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = Dual.of(o)
        q = self.value / o.value
        return Dual(q, (self.slope - q * o.slope) / o.value)

    def __rtruediv__(self, o):
        return Dual.of(o) / self

    def __pow__(self, n: float):
        return Dual(F.pow(self.value, F.lit(float(n))), self.slope * n * F.pow(self.value, F.lit(float(n - 1))))

    def apply(self, name: str) -> Dual:
        """A function of `_UNARY` by its symbolic slope."""
        x = Symbol("x")
        at = {"x": self.value}
        return Dual(column(call(name, x), at), self.slope * column(_slope(name, x), at))
