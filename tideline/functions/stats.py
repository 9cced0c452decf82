"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 7.1.26, for the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function to about 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + F.lit(c)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z >= 0, erf).otherwise(-erf))


def upper_tail(z: Column) -> Column:
    """The one-sided p of z, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - normal_cdf(z)))
