"""Scalar building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
MONTH_DAYS = 30.44


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (the session zone is UTC)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from `start` to `end`."""
    return (micros(end) - micros(start)) / float(DAY_US)


def whole_days(start: Column | str, end: Column | str) -> Column:
    return F.floor((micros(end) - micros(start)) / F.lit(DAY_US))


def uniform(salt: str, key: Column | str) -> Column:
    """First 8 bytes of sha256(salt + key) as a number in [0, 1): no state, no seed order."""
    digest = F.sha2(F.concat(F.lit(salt), c(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(2**64))


def expit(x: Column) -> Column:
    """Logistic function; exp overflows to infinity, which gives the right limit of 0."""
    return 1.0 / (1.0 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def logit(p: Column, edge: float = 1e-4) -> Column:
    q = clip(p, edge, 1.0 - edge)
    return F.ln(q / (1.0 - q))


def half_even(x: Column) -> Column:
    """Whole number with ties to even, as a long."""
    return F.bround(x, 0).cast("long")
