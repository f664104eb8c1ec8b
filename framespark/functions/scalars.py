"""Scalar functions of the domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mel_of_hz(f: Column) -> Column:
    return 1127 * F.log(1 + f / 700)


def hz_of_mel(m: Column) -> Column:
    return (F.exp(m / 1127) - 1) * 700


def cents_to_hz(c: Column) -> Column:
    """Hertz of cents above 10 Hz; 0 for no number."""
    return F.coalesce(F.nanvl(10 * F.pow(F.lit(2.0), c / 1200), F.lit(0.0)), F.lit(0.0))


def pov_of_nccf(nccf: Column) -> Column:
    """The voicing feature of a cross-correlation."""
    return 2 * (F.pow(1.0001 - F.least(F.abs(nccf), F.lit(1.0)), F.lit(0.15)) - 1)


def probability_of_nccf(nccf: Column) -> Column:
    """Probability of voicing of a cross-correlation: a fitted curve from the published description of the tracker."""
    n = F.least(F.abs(nccf), F.lit(1.0))
    r = -5.2 + 5.4 * F.exp(7.5 * (n - 1)) + 4.8 * n - 2 * F.exp(-10 * n) + 4.2 * F.exp(20 * (n - 1))
    return 1 / (1 + F.exp(-r))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logsumexp(x: Column) -> Column:
    """Of an array; null of an empty one."""
    m = F.array_max(x)
    return m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m)))
