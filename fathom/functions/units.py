"""Columns with physical dimensions: dimensions are checked while the plan is built and cost nothing at run time."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.errors import need

#: Base quantities in SI order.
BASE = ("m", "kg", "s", "A", "K", "mol", "cd")

#: Unit, factor to SI, exponents of the base quantities it has.
UNITS = {
    "1": (1.0, {}),
    "m": (1.0, {"m": 1}),
    "km": (1000.0, {"m": 1}),
    "kg": (1.0, {"kg": 1}),
    "g": (0.001, {"kg": 1}),
    "s": (1.0, {"s": 1}),
    "h": (3600.0, {"s": 1}),
    "A": (1.0, {"A": 1}),
    "K": (1.0, {"K": 1}),
    "mol": (1.0, {"mol": 1}),
    "cd": (1.0, {"cd": 1}),
    "m/s": (1.0, {"m": 1, "s": -1}),
    "N": (1.0, {"kg": 1, "m": 1, "s": -2}),
    "J": (1.0, {"kg": 1, "m": 2, "s": -2}),
    "Pa": (1.0, {"kg": 1, "m": -1, "s": -2}),
    "W": (1.0, {"kg": 1, "m": 2, "s": -3}),
}


@dataclass(frozen=True)
class Quantity:
    """A column in SI units and its dimension: one exponent a base quantity."""

    column: Column
    dimension: tuple[Fraction, ...]

    def _same(self, o: Quantity, what: str) -> None:
        need(self.dimension == o.dimension, f"cannot {what} {describe(self.dimension)} and {describe(o.dimension)}")

    def __add__(self, o: Quantity) -> Quantity:
        self._same(o, "add")
        return Quantity(self.column + o.column, self.dimension)

    def __sub__(self, o: Quantity) -> Quantity:
        self._same(o, "subtract")
        return Quantity(self.column - o.column, self.dimension)

    def __mul__(self, o) -> Quantity:
        if not isinstance(o, Quantity):
            return Quantity(self.column * o, self.dimension)
        return Quantity(self.column * o.column, tuple(a + b for a, b in zip(self.dimension, o.dimension, strict=True)))

    def __truediv__(self, o: Quantity) -> Quantity:
        return self * o**-1

    def __pow__(self, n) -> Quantity:
        n = Fraction(n)
        return Quantity(F.pow(self.column, F.lit(float(n))), tuple(a * n for a in self.dimension))

    def sqrt(self) -> Quantity:
        return self ** Fraction(1, 2)

    def to(self, unit: str) -> Column:
        """The column in a unit of the same dimension."""
        factor, dim = _unit(unit)
        need(dim == self.dimension, f"{describe(self.dimension)} is not measured in {unit}")
        return self.column / factor


def _unit(unit: str) -> tuple[float, tuple[Fraction, ...]]:
    need(unit in UNITS, f"no unit {unit}")
    factor, powers = UNITS[unit]
    return factor, tuple(Fraction(powers.get(b, 0)) for b in BASE)


def quantity(column: Column, unit: str) -> Quantity:
    factor, dim = _unit(unit)
    return Quantity(column * factor, dim)


def describe(dimension: tuple[Fraction, ...]) -> str:
    return " ".join(f"{b}^{p}" for b, p in zip(BASE, dimension, strict=True) if p) or "a plain number"
