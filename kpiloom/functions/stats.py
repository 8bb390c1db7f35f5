"""Normal and chi-square tail probabilities as Column expressions.

Spark has no ``erf``; this is Hart's double-precision rational approximation of
the normal CDF (published in W. J. Cody / J. F. Hart, as laid out by G. West,
"Better approximations to cumulative normal functions", 2005).  Absolute error
is below 1e-15 over the real line, which the unit tests check against
``math.erfc``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed coefficients of the approximation (numerator, denominator), highest
# degree first, and the continued-fraction tail constants.
_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
_SPLIT = 7.07106781186547
_CUTOFF = 37.0
_SQRT_2PI = 2.506628274631


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _lower_tail_abs(a: Column) -> Column:
    """Phi(-a) for a >= 0."""
    e = F.exp(-(a * a) / F.lit(2.0))
    rational = e * _horner(_NUM, a) / _horner(_DEN, a)
    cf = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + F.lit(0.65)))))
    tail = e / cf / F.lit(_SQRT_2PI)
    return F.when(a > _CUTOFF, F.lit(0.0)).when(a < _SPLIT, rational).otherwise(tail)


def norm_cdf(x) -> Column:
    """Standard normal CDF Phi(x)."""
    x = F.col(x) if isinstance(x, str) else x
    lo = _lower_tail_abs(F.abs(x))
    return F.when(x > 0, F.lit(1.0) - lo).otherwise(lo)


def norm_two_sided_p(z) -> Column:
    """2 * (1 - Phi(|z|)), computed as 2 * Phi(-|z|) (no cancellation)."""
    z = F.col(z) if isinstance(z, str) else z
    return F.lit(2.0) * _lower_tail_abs(F.abs(z))


def chi2_1df_sf(x) -> Column:
    """P(X > x) for chi-square with one degree of freedom = 2 * Phi(-sqrt(x))."""
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(2.0) * _lower_tail_abs(F.sqrt(x))


# Fixed coefficients of Wichura's algorithm AS 241 (1988), PPND16: numerator and denominator,
# highest degree first, for the centre, the near and the far tail.
_CENTRE = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080],
    [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0],
)
_NEAR = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 0.241780725177450611770, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 0.148103976427480074590,
     0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0],
)
_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 0.136929880922735805310, 0.599832206555887937690, 1.0],
)


def _ratio(table, x: Column) -> Column:
    return _horner(table[0], x) / _horner(table[1], x)


def norm_ppf(p) -> Column:
    """The standard normal quantile, z with Phi(z) = p (AS 241, relative error about
    1e-16); null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    side = F.when(tail <= 5.0, _ratio(_NEAR, tail - F.lit(1.6))).otherwise(_ratio(_FAR, tail - F.lit(5.0)))
    centre = q * _ratio(_CENTRE, F.lit(0.180625) - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).when(q < 0, -side).otherwise(side))
