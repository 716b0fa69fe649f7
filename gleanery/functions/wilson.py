"""Wilson intervals with finite population correction, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def wilson_ci(k: Column, n: Column, population: Column, level: float = 0.95) -> Column:
    """struct<p, lo, hi>: exact where the sample is the population, zeros where it is empty."""
    z = Z.get(level, 1.96)
    k, n, population = k.cast("double"), n.cast("double"), population.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    spread = spread * F.when(population > 1, F.sqrt((population - n) / (population - 1))).otherwise(1.0)
    zero = F.lit(0.0)
    return (
        F.when(n <= 0, F.struct(zero.alias("p"), zero.alias("lo"), zero.alias("hi")))
        .when(n >= population, F.struct(p.alias("p"), p.alias("lo"), p.alias("hi")))
        .otherwise(F.struct(p.alias("p"), F.greatest(zero, centre - spread).alias("lo"), F.least(F.lit(1.0), centre + spread).alias("hi")))
    )


def adjust_for_design(ci: Column, deff: Column) -> Column:
    """The interval widened about its middle by the root of the design effect (no-op at 1 or less)."""
    middle, half = (ci["lo"] + ci["hi"]) / 2, (ci["hi"] - ci["lo"]) / 2 * F.sqrt(deff)
    wide = F.struct(ci["p"].alias("p"), F.greatest(F.lit(0.0), middle - half).alias("lo"), F.least(F.lit(1.0), middle + half).alias("hi"))
    return F.when((deff <= 1) | (ci["lo"] == ci["hi"]), ci).otherwise(wide)


def format_ci(ci: Column, n: Column, population: Column) -> Column:
    whole = F.format_string("%.1f%% (exact, N=%d)", ci["p"] * 100, population.cast("long"))
    part = F.format_string("%.1f%% (CI: %.1f%% -- %.1f%%, n=%d)", ci["p"] * 100, ci["lo"] * 100, ci["hi"] * 100, n.cast("long"))
    return F.when(n >= population, whole).otherwise(part)


def auto_rate(population: Column, target: int = 3000) -> Column:
    """The sampling rate that takes about ``target`` of a population."""
    return F.when(population <= target, F.lit(1.0)).otherwise(F.lit(float(target)) / population)
