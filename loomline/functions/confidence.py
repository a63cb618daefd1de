"""Confidence that decays with age, and the maturity it earns.

An observation counts 0.04 (reinforcing) or -0.16 (correcting), halved every 90 days; the sum starts
from a floor and stays between 0.3 and 0.9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOWEST, HIGHEST, START = 0.3, 0.9, 0.5
HALF_LIFE_DAYS, GAIN, LOSS = 90.0, 0.04, 0.16
ESTABLISHED = {"confidence": 0.6, "days": 7, "reinforcing": 2}
PROVEN = {"confidence": 0.8, "days": 30, "reinforcing": 5}
MATURITY = ["candidate", "established", "proven", "deprecated"]


def days_between(start: Column, end: Column) -> Column:
    """Days from one timestamp to another, with fractions."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)


def weight(days: Column) -> Column:
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), days / HALF_LIFE_DAYS))


def contribution(reinforcing: Column, days: Column) -> Column:
    return F.when(reinforcing, F.lit(GAIN)).otherwise(F.lit(-LOSS)) * weight(days)


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), c))


def proposed(confidence: Column, days: Column, reinforcing: Column, survived: Column, deprecated: Column | None = None) -> Column:
    """The maturity that counts and age allow; a deprecated record comes back only above 0.4."""

    def reaches(level: dict) -> Column:
        return (confidence >= level["confidence"]) & (days >= level["days"]) & (reinforcing >= level["reinforcing"])

    found = (
        F.when(confidence < LOWEST + 0.001, "deprecated")
        .when(reaches(PROVEN) & survived, "proven")
        .when(reaches(ESTABLISHED), "established")
        .otherwise("candidate")
    )
    if deprecated is None:
        return found
    return F.when(deprecated, F.when(confidence > LOWEST + 0.1, "candidate").otherwise("deprecated")).otherwise(found)


def survived(flags: Column) -> Column:
    """Whether two reinforcing observations follow the first correction; ``flags`` are booleans in order."""
    at = F.array_position(flags, F.lit(False))
    after = F.filter(flags, lambda f, i: f & (i >= at))
    return (at > 0) & (F.size(after) >= 2)
