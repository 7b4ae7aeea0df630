"""Normal distribution as column expressions: quantile and upper tail, to double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Wichura (1988), algorithm AS 241, ascending powers (numerator, denominator).
QUANTILE_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
QUANTILE_TAIL = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
QUANTILE_FAR = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)
# Cody (1969), rational approximations of the error function, ascending powers.
ERF_SMALL = (
    [3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2,
     3.16112374387056560e0, 1.85777706184603153e-1],
    [2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2,
     2.36012909523441209e1, 1.0],
)
ERFC_MIDDLE = (
    [1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3,
     8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1,
     8.88314979438837594e0, 5.64188496988670089e-1, 2.15311535474403846e-8],
    [1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3,
     3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2,
     1.17693950891312499e2, 1.57449261107098347e1, 1.0],
)
ERFC_LARGE = (
    [6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
     3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2],
    [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
     1.87295284992346725e0, 2.56852019228982242e0, 1.0],
)
# End of fixed values.


def poly(coefficients: list[float], x: Column) -> Column:
    """Polynomial with ascending coefficients."""
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def _ratio(parts: tuple[list[float], list[float]], x: Column) -> Column:
    return poly(parts[0], x) / poly(parts[1], x)


def tail_depth(p: Column) -> Column:
    """How far ``p`` lies in a tail; the second argument of :func:`normal_quantile`."""
    return F.sqrt(-F.log(F.least(p, 1 - p)))


def normal_quantile(p: Column, t: Column | None = None) -> Column:
    """The value below which a standard normal lies with probability ``p`` (0 < p < 1).

    Both arguments occur many times in the expression: pass columns, not long expressions, and
    ``t`` (:func:`tail_depth` of ``p``) as a column of its own where many rows are computed.
    """
    q = p - F.lit(0.5)
    t = tail_depth(p) if t is None else t
    outer = F.when(t <= 5, _ratio(QUANTILE_TAIL, t - 1.6)).otherwise(_ratio(QUANTILE_FAR, t - 5))
    centre = q * _ratio(QUANTILE_CENTRE, F.lit(0.180625) - q * q)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal lies above ``z`` (pass a column: it occurs often)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    inverse = 1 / (x * x)
    shrink = F.exp(-x * x)
    large = shrink * (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(ERFC_LARGE, inverse)) / x
    erfc = (
        F.when(x <= 0.46875, 1 - x * _ratio(ERF_SMALL, x * x))
        .when(x <= 4, shrink * _ratio(ERFC_MIDDLE, x))
        .otherwise(large)
    )
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)
