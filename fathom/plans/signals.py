"""Queries of spectra and interpolants, with direct sums and closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.catalog import query, t
from fathom.functions import interpolants, spectra


def _orders(s, d):
    """A signal an order: quantities by line number."""
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    return x.select("l_orderkey", F.transform("x", lambda v: v["l_quantity"].cast("double")).alias("x"))


_SIGNAL = """x AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, l_quantity::DOUBLE AS v, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


@query(f"""WITH {_SIGNAL}, k AS (SELECT DISTINCT o, n, unnest(range(n)) AS k FROM x)
SELECT k.o AS l_orderkey, k.k::INTEGER AS k, sum(v * cos(2 * pi() * i * k / k.n)) AS re, -sum(v * sin(2 * pi() * i * k / k.n)) AS im, max(CASE WHEN i = k THEN v END) AS back, 0.0::DOUBLE AS back_im
FROM k JOIN x ON k.o = x.o GROUP BY k.o, k.k""")
def fourier_transform(s, d):
    """Spectra of all orders, and the way back."""
    x = _orders(s, d).withColumn("z", spectra.fft(F.col("x")))
    x = x.withColumn("b", spectra.ifft(F.col("z.re"), F.col("z.im")))
    x = x.select("l_orderkey", F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"), F.col("b.re").alias("back"), F.col("b.im").alias("back_im"))).alias("k", "v"))
    return x.select("l_orderkey", "k", "v.re", "v.im", "v.back", F.abs(F.round("v.back_im", 6)).alias("back_im"))


@query(f"""WITH {_SIGNAL}, h AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, -1.0::DOUBLE), (2, 2.0::DOUBLE)) h(j, w)),
c AS (SELECT o, i + j AS k, sum(v * w) AS convolved FROM x, h GROUP BY ALL), r AS (SELECT o, i - j + 2 AS k, sum(v * w) AS correlated FROM x, h GROUP BY ALL)
SELECT c.o AS l_orderkey, c.k::INTEGER AS k, convolved, correlated FROM c JOIN r ON c.o = r.o AND c.k = r.k""")
def convolution(s, d):
    x = _orders(s, d).withColumn("h", F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0)))
    x = x.select("l_orderkey", F.posexplode(F.arrays_zip(spectra.convolve(F.col("x"), F.col("h")).alias("a"), spectra.correlate(F.col("x"), F.col("h")).alias("b"))).alias("k", "v"))
    return x.select("l_orderkey", "k", F.col("v.a").alias("convolved"), F.col("v.b").alias("correlated"))


@query(f"""WITH {_SIGNAL}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY o) AS w FROM x), k AS (SELECT DISTINCT o, n, unnest(range(n // 2 + 1)) AS k FROM m)
SELECT k.o AS l_orderkey, k.k::INTEGER AS k, CASE WHEN k.k > 0 AND 2 * k.k < k.n THEN 2 ELSE 1 END * (power(sum(w * cos(2 * pi() * i * k / k.n)), 2) + power(sum(w * sin(2 * pi() * i * k / k.n)), 2)) / (10.0::DOUBLE * k.n) AS power
FROM k JOIN m ON k.o = m.o GROUP BY k.o, k.k, k.n""")
def periodogram(s, d):
    x = _orders(s, d).select("l_orderkey", F.posexplode(spectra.periodogram(F.col("x"), 10.0)).alias("k", "power"))
    return x.select("l_orderkey", "k", "power")


@query(f"""WITH {_SIGNAL}, p AS (SELECT o, n, i, v, sum(v) OVER (PARTITION BY o) AS total FROM x WHERE n IN (2, 4, 6)),
q AS (SELECT a.o, a.i, max(a.v) AS v, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.v * 2.0::DOUBLE / a.n / tan(pi() * (a.i - b.i) / a.n) ELSE 0 END) AS turned FROM p a JOIN p b ON a.o = b.o GROUP BY a.o, a.i)
SELECT o AS l_orderkey, i::INTEGER AS k, v AS re, turned AS im FROM q""")
def analytic_signal(s, d):
    """Signals of even length with their quadrature, of which SQL has the closed sum."""
    x = _orders(s, d).where(F.size("x").isin(2, 4, 6)).withColumn("z", spectra.hilbert(F.col("x")))
    return x.select("l_orderkey", F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias("k", "v")).select("l_orderkey", "k", "v.re", "v.im")


@query("""WITH x AS (SELECT event_id, (event_id % 9)::DOUBLE AS i FROM events), k AS (SELECT i, sum(power(2.25 * greatest(1 - power(i / 4 - 1, 2), 0), k) / power(gamma(k + 1), 2)) / sum(power(2.25::DOUBLE, k) / power(gamma(k + 1), 2)) AS kaiser FROM (SELECT DISTINCT i FROM x), range(25) r(k) GROUP BY i)
SELECT event_id, 1.0::DOUBLE AS rectangular, 0.5 - 0.5 * cos(pi() * i / 4) AS hann, 0.54 - 0.46 * cos(pi() * i / 4) AS hamming, 0.42 - 0.5 * cos(pi() * i / 4) + 0.08 * cos(pi() * i / 2) AS blackman,
    0.21557895 - 0.41663158 * cos(pi() * i / 4) + 0.277263158 * cos(pi() * i / 2) - 0.083578947 * cos(3 * pi() * i / 4) + 0.006947368 * cos(pi() * i) AS flat_top, kaiser FROM x JOIN k USING (i)""")
def tapers(s, d):
    i = (F.col("event_id") % 9).cast("double")
    named = [spectra.taper(n, i, 9).alias(n.replace(" ", "_")) for n in ("rectangular", "hann", "hamming", "blackman", "flat top")]
    return t(s, d, "events").select("event_id", *named, spectra.kaiser(i, 9, 3.0).alias("kaiser"))


@query("""WITH x AS (SELECT event_id, (event_id % 301) / 100.0::DOUBLE AS x FROM events), p AS (SELECT *, least(floor(x), 2) AS k, x - least(floor(x), 2) AS e FROM x)
SELECT event_id, CASE k WHEN 0 THEN x + 2.0 / 3 * (x - x * x * x) WHEN 1 THEN (1 - e) + -4.0 / 6 * (power(1 - e, 3) - (1 - e)) + 4.0 / 6 * (e * e * e - e) ELSE e + 4.0 / 6 * (power(1 - e, 3) - (1 - e)) END AS cubic,
    CASE k WHEN 0 THEN 1 + 2.0 / 3 * (1 - 3 * x * x) WHEN 1 THEN -1 + -4.0 / 6 * (1 - 3 * power(1 - e, 2)) + 4.0 / 6 * (3 * e * e - 1) ELSE 1 + 4.0 / 6 * (1 - 3 * power(1 - e, 2)) END AS cubic_slope,
    2 * x + 1 AS akima, 2.0::DOUBLE AS akima_slope, 1 - x + 3 * x * x AS lagrange, 1 - x + 3 * x * x AS neville,
    (exp(-power(x, 2)) * (1 - 3 * exp(-4.0)) + exp(-power(x - 2, 2)) * (3 - exp(-4.0))) / (1 - exp(-8.0)) AS radial, CASE WHEN x <= 1 THEN 1 + 2.25 * x ELSE 3.25 + (x - 1) * 0.375 END AS bilinear FROM p""")
def interpolants_through_knots(s, d):
    x = F.col("x")
    e = t(s, d, "events").select("event_id", ((F.col("event_id") % 301) / 100.0).alias("x"))
    cubic, akima = interpolants.cubic_spline([0, 1, 2, 3], [0, 1, 0, 1]), interpolants.akima_spline([0, 0.5, 1, 2, 3.5], [1, 2, 3, 5, 8])
    knots = ([0, 1, 2.5], [1, 3, 17.25])
    return e.select(
        "event_id", cubic.value(x).alias("cubic"), cubic.slope(x).alias("cubic_slope"), akima.value(x).alias("akima"), akima.slope(x).alias("akima_slope"), interpolants.lagrange(x, *knots).alias("lagrange"),
        interpolants.neville(x, *knots).alias("neville"), interpolants.radial([x], [[0], [2]], [1, 3]).alias("radial"), interpolants.bilinear(x, F.lit(0.25), [0, 1, 3], [0, 1], [[1, 1], [3, 4], [4, 4]]).alias("bilinear"),
    )
