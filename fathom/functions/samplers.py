"""Random columns: draws that depend on a seed and a row's key alone, so a lost task draws the same again.

A draw is a function of uniforms hashed from (seed, stream, key). Distributions are drawn by their quantiles or by closed
transforms, in generated code where there is one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import distributions as D
from fathom.functions import quantiles as Q


class Sampler:
    def __init__(self, *key: Column, seed: int = 0):
        self.key, self.seed, self.stream = key, seed, 0

    def bits(self) -> Column:
        """64 random bits as a long; each call is a new stream."""
        self.stream += 1
        return F.xxhash64(F.lit(self.seed).cast("long"), F.lit(self.stream), *self.key)

    def parallel(self, n: int) -> list[Sampler]:
        """Samplers that share nothing."""
        return [Sampler(*self.key, F.lit(k), seed=self.seed) for k in range(n)]

    def uniform(self, low=0.0, high=1.0) -> Column:
        """Strictly between low and high: 53 bits, in the middle of their cell."""
        return low + (high - low) * ((F.shiftrightunsigned(self.bits(), 11) + 0.5) / float(1 << 53))

    def integer(self, low: int, high: int) -> Column:
        """low <= x < high; high - low must be below 2**40."""
        return (F.lit(low) + F.floor(self.uniform() * (high - low))).cast("long")

    def boolean(self, p: float = 0.5) -> Column:
        return self.uniform() < p

    def normal(self, mean=0.0, sd=1.0) -> Column:
        """Box and Muller."""
        return mean + sd * F.sqrt(-2 * F.ln(self.uniform())) * F.cos(2 * math.pi * self.uniform())

    def exponential(self, rate=1.0) -> Column:
        return -F.ln(self.uniform()) / rate

    def lognormal(self, mean=0.0, sd=1.0) -> Column:
        return F.exp(self.normal(mean, sd))

    def weibull(self, shape: float, scale: float = 1.0) -> Column:
        return scale * F.pow(-F.ln(self.uniform()), F.lit(1.0 / shape))

    def cauchy(self, mean=0.0, scale=1.0) -> Column:
        return D.cauchy_quantile(self.uniform(), mean, scale)

    def laplace(self, mean=0.0, scale=1.0) -> Column:
        u = self.uniform(-0.5, 0.5)
        return mean - scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))

    def logistic(self, mean=0.0, scale=1.0) -> Column:
        e = self.exponential()
        return mean - scale * F.ln(F.expm1(e))

    def pareto(self, shape: float, low: float = 1.0) -> Column:
        return low * F.exp(self.exponential() / shape)

    def gamma(self, shape: float, rate: float = 1.0) -> Column:
        return Q.column(Q.gamma_quantile, self.uniform(), shape, rate)

    def chi_squared(self, df: float) -> Column:
        return self.gamma(df / 2, 0.5)

    def beta(self, a: float, b: float) -> Column:
        return Q.column(Q.beta_quantile, self.uniform(), a, b)

    def student_t(self, df: float) -> Column:
        return Q.column(Q.t_quantile, self.uniform(), df)

    def poisson(self, mean: float) -> Column:
        """The count whose distribution function first reaches a uniform (for means up to about 500)."""
        most = int(mean + 12 * math.sqrt(mean) + 30)
        return self._counted([-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(most)] if mean > 0 else [0.0])

    def binomial(self, n: int, p: float) -> Column:
        if p in (0, 1):
            return F.lit(n * p).cast("long")
        return self._counted([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)])

    def geometric(self, p: float) -> Column:
        """Failures before the first success."""
        return F.floor(F.ln(self.uniform()) / math.log1p(-p)).cast("long") if p < 1 else F.lit(0).cast("long")

    def choice(self, weights: list[float]) -> Column:
        """Index of an outcome, by its weight."""
        total = sum(weights)
        return self._counted([math.log(w / total) if w > 0 else -math.inf for w in weights])

    def _counted(self, logs: list[float]) -> Column:
        upto, total = [], 0.0
        for x in logs:
            total += math.exp(x)
            upto.append(min(total, 1.0))
        u = self.uniform()
        below = F.size(F.filter(F.array(*map(F.lit, upto[:-1])), lambda c: c < u)) if len(upto) > 1 else F.lit(0)
        return below.cast("long")

    def on_sphere(self, n: int = 3) -> tuple[Column, ...]:
        """A direction: normals divided by their length."""
        x = [self.normal() for _ in range(n)]
        size = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
        return tuple(v / size for v in x)

    def in_disk(self, radius: float = 1.0) -> tuple[Column, Column]:
        r, a = radius * F.sqrt(self.uniform()), self.uniform(0.0, 2 * math.pi)
        return r * F.cos(a), r * F.sin(a)

    def shuffled_order(self) -> Column:
        """Rows sorted by this stand in random order."""
        return self.bits()


def halton(i: Column, base: int) -> Column:
    """Element i (from 1) of the sequence of radical inverses."""
    digits = max(1, math.ceil(40 / math.log2(base)))
    start = F.struct(i.cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(1.0).alias("f"))
    step = lambda s, _: F.struct(F.floor(s["n"] / base).cast("long").alias("n"), (s["x"] + (s["n"] % base) * s["f"] / base).alias("x"), (s["f"] / base).alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda s: s["x"])


def latin_hypercube(rank: Column, n: Column | int, within: Column) -> Column:
    """The point of one of n strata: rank is a random permutation of 0 .. n - 1 for each dimension, within a uniform."""
    return (rank + within) / n


def sobol_2(i: Column) -> tuple[Column, Column]:
    """Point i (from 0) of the two-dimensional Sobol sequence: bits reversed, and the direction numbers of x + 1."""
    first, second, v = F.lit(0).cast("long"), F.lit(0).cast("long"), 1 << 31
    for k in range(32):
        on = F.shiftright(i.cast("long"), k).bitwiseAND(F.lit(1).cast("long")) == 1
        first = first.bitwiseXOR(F.when(on, F.lit(1 << (31 - k)).cast("long")).otherwise(F.lit(0).cast("long")))
        second = second.bitwiseXOR(F.when(on, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")))
        v = v ^ (v >> 1)
    return first / float(1 << 32), second / float(1 << 32)
