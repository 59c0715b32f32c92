"""Column expressions for statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation of the rows with both values, an aggregate; null where either never varies."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def weighted_median(entries: Column) -> Column:
    """Lower weighted median of array<struct<v, w>>: the first value that reaches half of the weight."""
    ordered = F.sort_array(entries)
    half = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["w"]) / 2.0
    walk = F.aggregate(
        ordered,
        F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"), half.alias("half")),  # half is carried, or each entry would add up all
        lambda s, e: F.struct((s["w"] + e["w"]).alias("w"), F.when(s["v"].isNull() & (s["w"] + e["w"] >= s["half"]), e["v"]).otherwise(s["v"]).alias("v"), s["half"].alias("half")),
        lambda s: s["v"],
    )
    return walk


def wilson(wins: Column, n: Column, high: bool, z: float = 1.96) -> Column:
    """A bound of the Wilson score interval; 0 for no trials."""
    p = wins / n
    d = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / d
    margin = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / d
    bound = F.least(F.lit(1.0), centre + margin) if high else F.greatest(F.lit(0.0), centre - margin)
    return F.when(n > 0, bound).otherwise(0.0)


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by Abramowitz and Stegun 7.1.26; error under 1.5e-7."""
    z = F.abs(x) / 1.4142135623730951
    t = 1.0 / (1.0 + 0.3275911 * z)
    # The coefficients of the formula.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-z * z) / 2.0
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at a number of digits; the same in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale
