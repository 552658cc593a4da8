"""Closed forms as columns: counting, means, small systems, intervals, fractions, uncertain values, polynomials, activations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.distributions import ln_gamma


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# counting; beyond 20! no long holds a factorial, so null


def factorial(n: Column) -> Column:
    return F.when(n.between(0, 20), F.factorial(n.cast("int")))


def permutations(n: Column, k: Column) -> Column:
    """Ordered choices of k out of n, up to n = 20."""
    return F.when((k >= 0) & (k <= n), (factorial(n) / factorial(n - k)).cast("long")).when(k > n, F.lit(0).cast("long"))


# means of an array; null where they are not defined


def arithmetic_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def geometric_mean(a: Column) -> Column:
    return F.when((F.size(a) > 0) & F.forall(a, lambda x: x > 0), F.exp(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.ln(x)) / F.size(a)))


def harmonic_mean(a: Column) -> Column:
    return F.when((F.size(a) > 0) & F.forall(a, lambda x: x != 0), F.size(a) / F.aggregate(a, F.lit(0.0), lambda s, x: s + 1 / x))


def solve_linear(a: Column, b: Column) -> Column:
    """x of a * x + b = 0."""
    return F.when(a != 0, -b / a)


@dataclass(frozen=True)
class Interval:
    """Closed intervals [low, high]; arithmetic gives all values that members can give."""

    low: Column
    high: Column

    def midpoint(self) -> Column:
        return (self.low + self.high) / 2

    def radius(self) -> Column:
        return (self.high - self.low) / 2

    def width(self) -> Column:
        return self.high - self.low

    def contains(self, x) -> Column:
        return (self.low <= x) & (_c(x) <= self.high)

    def meets(self, o: Interval) -> Column:
        return (self.low <= o.high) & (o.low <= self.high)

    def intersection(self, o: Interval) -> Interval:
        """Null ends where they have nothing in common."""
        low, high = F.greatest(self.low, o.low), F.least(self.high, o.high)
        return Interval(F.when(low <= high, low), F.when(low <= high, high))

    def hull(self, o: Interval) -> Interval:
        return Interval(F.least(self.low, o.low), F.greatest(self.high, o.high))

    def __add__(self, o: Interval) -> Interval:
        return Interval(self.low + o.low, self.high + o.high)

    def __sub__(self, o: Interval) -> Interval:
        return Interval(self.low - o.high, self.high - o.low)

    def __neg__(self) -> Interval:
        return Interval(-self.high, -self.low)

    def __mul__(self, o: Interval) -> Interval:
        p = [a * b for a in (self.low, self.high) for b in (o.low, o.high)]
        return Interval(F.least(*p), F.greatest(*p))

    def __truediv__(self, o: Interval) -> Interval:
        """Null where the divisor holds nothing."""
        safe = ~o.contains(0.0)
        q = self * Interval(F.when(safe, 1 / F.when(safe, o.high)), F.when(safe, 1 / F.when(safe, o.low)))
        return q

    def sqrt(self) -> Interval:
        return Interval(F.when(self.low >= 0, F.sqrt(self.low)), F.when(self.low >= 0, F.sqrt(self.high)))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def gcd(a: Column, b: Column, rounds: int = 92) -> Column:
    """Greatest common divisor of longs by Euclid's steps (92 suffice for any two longs)."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    rest = lambda s: F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"]))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), rest(s).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["a"])


def _div(a: Column, b: Column) -> Column:
    """a / b of longs where b divides a; null where b is nothing."""
    return F.call_function("div", a, F.when(b != 0, b))


def _lowest(n: Column, d: Column) -> Column:
    """struct(n, d) in lowest terms with d above nothing."""

    def reduced(x: Column) -> Column:
        sign = F.when(x["d"] < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
        return F.when((x["d"] != 0) & x["n"].isNotNull(), F.struct(F.try_multiply(_div(x["n"], x["g"]), sign).alias("n"), F.try_multiply(_div(x["d"], x["g"]), sign).alias("d")))

    n, d = n.cast("long"), d.cast("long")
    return _bound(F.struct(n.alias("n"), d.alias("d")), lambda v: _bound(F.struct(v["n"].alias("n"), v["d"].alias("d"), gcd(v["n"], v["d"]).alias("g")), reduced))


class Rational:
    """Exact fractions of longs in lowest terms with a positive denominator; null where the denominator is nothing or a long
    is too small for the result. A fraction is one struct(n, d) column, so each operation is worked out once."""

    def __init__(self, fraction: Column):
        self.fraction = fraction

    @staticmethod
    def of(numer, denom=1) -> Rational:
        return Rational(_lowest(_c(numer), _c(denom)))

    @property
    def numer(self) -> Column:
        return self.fraction["n"]

    @property
    def denom(self) -> Column:
        return self.fraction["d"]

    def _with(self, o: Rational, f: Callable[[Column, Column, Column, Column], Column]) -> Rational:
        return Rational(_bound(F.struct(self.fraction.alias("p"), o.fraction.alias("q")), lambda x: f(x["p"]["n"], x["p"]["d"], x["q"]["n"], x["q"]["d"])))

    def _sum(self, o: Rational, combine: Callable[[Column, Column], Column]) -> Rational:
        def f(a, b, c, d):
            # over the least common denominator
            g = gcd(b, d)
            return _bound(g, lambda k: _lowest(combine(F.try_multiply(a, _div(d, k)), F.try_multiply(c, _div(b, k))), F.try_multiply(b, _div(d, k))))

        return self._with(o, f)

    def __add__(self, o: Rational) -> Rational:
        return self._sum(o, F.try_add)

    def __sub__(self, o: Rational) -> Rational:
        return self._sum(o, F.try_subtract)

    def __mul__(self, o: Rational) -> Rational:
        def f(a, b, c, d):
            # crosswise common parts go first, so that only the result must fit
            both = F.struct(gcd(a, d).alias("g"), gcd(c, b).alias("h"))
            return _bound(both, lambda k: _lowest(F.try_multiply(_div(a, k["g"]), _div(c, k["h"])), F.try_multiply(_div(b, k["h"]), _div(d, k["g"]))))

        return self._with(o, f)

    def __truediv__(self, o: Rational) -> Rational:
        return self * o.reciprocal()

    def reciprocal(self) -> Rational:
        return Rational(_bound(self.fraction, lambda x: _lowest(x["d"], x["n"])))

    def __abs__(self) -> Rational:
        return Rational(_bound(self.fraction, lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["n"]).alias("n"), x["d"].alias("d")))))

    def power(self, n: int) -> Rational:
        """A power of lowest terms is in lowest terms."""

        def raised(x: Column) -> Column:
            out = one = F.lit(1).cast("long")
            for _ in range(abs(n)):
                out = F.try_multiply(out, x)
            return out if n else one

        base = self if n >= 0 else self.reciprocal()
        return Rational(_bound(base.fraction, lambda x: F.when(x.isNotNull() & raised(x["n"]).isNotNull() & raised(x["d"]).isNotNull(), F.struct(raised(x["n"]).alias("n"), raised(x["d"]).alias("d")))))

    def value(self) -> Column:
        return self.numer / self.denom


@dataclass(frozen=True)
class Uncertain:
    """Values with a standard deviation, carried to first order; errors are independent."""

    value: Column
    sd: Column

    def relative(self) -> Column:
        return self.sd / F.abs(self.value)

    def _map(self, f: Column, slope: Column) -> Uncertain:
        return Uncertain(f, F.abs(slope) * self.sd)

    def __add__(self, o: Uncertain) -> Uncertain:
        return Uncertain(self.value + o.value, F.hypot(self.sd, o.sd))

    def __sub__(self, o: Uncertain) -> Uncertain:
        return Uncertain(self.value - o.value, F.hypot(self.sd, o.sd))

    def __mul__(self, o: Uncertain) -> Uncertain:
        return Uncertain(self.value * o.value, F.hypot(self.sd * o.value, o.sd * self.value))

    def __truediv__(self, o: Uncertain) -> Uncertain:
        return Uncertain(self.value / o.value, F.hypot(self.sd / o.value, o.sd * self.value / (o.value * o.value)))

    def power(self, n: float) -> Uncertain:
        return self._map(F.pow(self.value, F.lit(float(n))), n * F.pow(self.value, F.lit(float(n - 1))))

    def sqrt(self) -> Uncertain:
        return self._map(F.sqrt(self.value), 0.5 / F.sqrt(self.value))

    def exp(self) -> Uncertain:
        return self._map(F.exp(self.value), F.exp(self.value))

    def ln(self) -> Uncertain:
        return self._map(F.ln(self.value), 1 / self.value)

    def sin(self) -> Uncertain:
        return self._map(F.sin(self.value), F.cos(self.value))

    def cos(self) -> Uncertain:
        return self._map(F.cos(self.value), F.sin(self.value))


@dataclass(frozen=True)
class Polynomial:
    """Coefficients by ascending power, each a column or a number."""

    coefficients: tuple

    @property
    def degree(self) -> int:
        return len(self.coefficients) - 1

    def leading(self) -> Column:
        return _c(self.coefficients[-1])

    def __add__(self, o: Polynomial) -> Polynomial:
        n = max(len(self.coefficients), len(o.coefficients))
        at = lambda p, i: _c(p.coefficients[i]) if i < len(p.coefficients) else F.lit(0.0)
        return Polynomial(tuple(at(self, i) + at(o, i) for i in range(n)))

    def __neg__(self) -> Polynomial:
        return Polynomial(tuple(-_c(c) for c in self.coefficients))

    def __sub__(self, o: Polynomial) -> Polynomial:
        return self + -o

    def __mul__(self, o: Polynomial) -> Polynomial:
        out: list = [F.lit(0.0)] * (len(self.coefficients) + len(o.coefficients) - 1)
        for i, a in enumerate(self.coefficients):
            for j, b in enumerate(o.coefficients):
                out[i + j] = out[i + j] + _c(a) * _c(b)
        return Polynomial(tuple(out))

    def divide(self, o: Polynomial) -> tuple[Polynomial, Polynomial]:
        """Quotient and rest; null where the divisor's leading coefficient is nothing."""
        rest, d = [_c(c) for c in self.coefficients], [_c(c) for c in o.coefficients]
        out = []
        for k in range(len(rest) - len(d), -1, -1):
            f = F.when(d[-1] != 0, rest[k + len(d) - 1] / F.when(d[-1] != 0, d[-1]))
            out.append(f)
            for i, c in enumerate(d):
                rest[k + i] = rest[k + i] - f * c
        return Polynomial(tuple(reversed(out)) or (F.lit(0.0),)), Polynomial(tuple(rest[: len(d) - 1]) or (F.lit(0.0),))

    def derivative(self) -> Polynomial:
        return Polynomial(tuple(_c(c) * float(i) for i, c in enumerate(self.coefficients) if i) or (F.lit(0.0),))

    def integral(self, constant=0.0) -> Polynomial:
        return Polynomial((_c(constant), *(_c(c) / float(i + 1) for i, c in enumerate(self.coefficients))))

    def value(self, x: Column) -> Column:
        out = _c(self.coefficients[-1])
        for c in reversed(self.coefficients[:-1]):
            out = out * x + _c(c)
        return out


ACTIVATIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "relu": (lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.when(x > 0, 1.0).otherwise(0.0)),
    "leaky": (lambda x: F.when(x > 0, x).otherwise(0.01 * x), lambda x: F.when(x > 0, 1.0).otherwise(0.01)),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), lambda x: F.exp(-x) / ((1 + F.exp(-x)) * (1 + F.exp(-x)))),
    "tanh": (F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x)),
    "identity": (lambda x: x, lambda x: F.lit(1.0)),
}


def activation(name: str, x: Column) -> Column:
    return ACTIVATIONS[name][0](x)


def activation_slope(name: str, x: Column) -> Column:
    return ACTIVATIONS[name][1](x)


def gamma(x: Column) -> Column:
    """Gamma function, reflected below a half; null at 0, -1, -2 and so on."""
    up = F.exp(ln_gamma(F.when(x >= 0.5, x).otherwise(1 - x)))
    pole = (x <= 0) & (x == F.floor(x))
    return F.when(x >= 0.5, up).when(~pole, math.pi / (F.sin(math.pi * x) * up))
