"""Financial formulas, unit conversion and quantiles as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Factors to the base unit of each kind (metre, gram, litre, square metre).
UNITS = {
    "length": {"nm": 1e-9, "μm": 1e-6, "mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "mil": 2.54e-5},
    "weight": {"mg": 0.001, "g": 1.0, "kg": 1000.0, "t": 1e6, "oz": 28.3495, "lb": 453.592, "st": 6350.29, "ton": 907185.0},
    "volume": {
        "ml": 0.001, "cl": 0.01, "dl": 0.1, "l": 1.0, "kl": 1000.0, "fl_oz": 0.0295735, "cup": 0.236588, "pt": 0.473176, "qt": 0.946353, "gal": 3.78541,
        "tsp": 0.00492892, "tbsp": 0.0147868, "bbl": 158.987,
    },
    "area": {"mm2": 1e-6, "cm2": 1e-4, "m2": 1.0, "km2": 1e6, "in2": 6.4516e-4, "ft2": 0.092903, "yd2": 0.836127, "mi2": 2589988.11, "acre": 4046.86, "ha": 10000.0},
}


def compound(principal: Column, rate: Column, years: Column, per_year: int = 12) -> Column:
    return principal * F.pow(1 + rate / per_year, years * per_year)


def effective_rate(rate: Column, per_year: int = 12) -> Column:
    return F.pow(1 + rate / per_year, F.lit(per_year)) - 1


def simple_interest(principal: Column, rate: Column, years: Column) -> Column:
    return principal * rate * years


def loan_payment(principal: Column, rate: Column, years: Column, per_year: int = 12) -> Column:
    n, r = years * per_year, rate / per_year
    return F.when(r == 0, principal / n).otherwise(principal * r * F.pow(1 + r, n) / (F.pow(1 + r, n) - 1))


def roi(gain: Column, cost: Column) -> Column:
    return F.when(cost != 0, (gain - cost) / cost * 100)


def annual_roi(gain: Column, cost: Column, years: Column) -> Column:
    return F.when((cost != 0) & (years > 0), (F.pow(gain / cost, 1 / years) - 1) * 100)


def present_value(future: Column, rate: Column, years: Column) -> Column:
    return future / F.pow(1 + rate, years)


def future_value(present: Column, rate: Column, years: Column) -> Column:
    return present * F.pow(1 + rate, years)


def npv(flows: Column, rate: Column) -> Column:
    """Net present value of an array of flows, the first one undiscounted."""
    parts = F.transform(flows, lambda x, i: x / F.pow(1 + rate, i))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def irr(flows: Column, steps: int = 100, tolerance: float = 1e-6) -> Column:
    """Internal rate of return by Newton steps from 0.1; null where it does not converge. All rows of a
    batch step together until each has converged or left the domain."""
    @F.pandas_udf("double")
    def solve(rows: pd.Series) -> pd.Series:
        size = max((len(r) for r in rows if r is not None), default=0)
        out = np.full(len(rows), np.nan)
        for i0 in range(0, len(rows), 8192):
            some = rows.iloc[i0 : i0 + 8192]
            x = np.array([[*r, *[0.0] * (size - len(r))] if r is not None else [0.0] * size for r in some], dtype=float).reshape(len(some), size)
            t, rate, open_ = np.arange(size), np.full(len(some), 0.1), np.arange(len(some))
            with np.errstate(all="ignore"):
                for _ in range(steps):
                    if not len(open_):
                        break
                    r = rate[open_][:, None]
                    now = x[open_] / (1 + r) ** t
                    new = rate[open_] - now.sum(1) / (-(t * now) / (1 + r)).sum(1)
                    met = np.abs(new - rate[open_]) < tolerance
                    rate[open_] = new
                    out[i0 + open_[met]] = new[met]
                    open_ = open_[~met & np.isfinite(new)]
        return pd.Series(out).replace({np.nan: None}).astype("float64")

    return solve(flows.cast("array<double>"))


def convert(value: Column, kind: str, source: str, target: str) -> Column:
    return value * UNITS[kind][source] / UNITS[kind][target]


def convert_temperature(value: Column, source: str, target: str) -> Column:
    """Through Celsius; null below absolute zero for the absolute scales."""
    c = {"C": value, "F": (value - 32) * 5 / 9, "K": value - 273.15, "R": (value - 491.67) * 5 / 9}[source]
    out = {"C": c, "F": c * 9 / 5 + 32, "K": c + 273.15, "R": (c + 273.15) * 9 / 5}[target]
    return F.when(out >= 0, out) if target in ("K", "R") else out


#: Cells that the range of a group's values is cut into when ranks are counted.
CELLS = 4096


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name): values of the data at which the shares are reached. Values are
    counted in cells of their group's range first; only the cells that hold a wanted rank are counted by
    value, so a group of any size is never gathered."""
    v = F.col(value)
    rows = df.select(*by, value).filter(v.isNotNull())
    ends = rows.groupBy(*by).agg(F.min(v).alias("_low"), F.max(v).alias("_high"), F.count("*").alias("_n"))
    wide = F.when(F.col("_high") > F.col("_low"), (v - F.col("_low")) / (F.col("_high") - F.col("_low")) * (CELLS - 1)).otherwise(0)
    celled = rows.join(ends, by).select(*by, value, "_n", F.floor(wide).alias("_cell"))
    counts = celled.groupBy(*by, "_cell").agg(F.count("*").alias("_count"), F.first("_n").alias("_n"))
    # a group has CELLS rows here at most
    w = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * F.lit(p), 6))).alias("rank")) for k, p in shares.items()])
    run = counts.withColumn("_to", F.sum("_count").over(w)).withColumn("_want", F.explode(ranks))
    wanted = run.filter("_want.rank <= _to and _want.rank > _to - _count").select(*by, "_cell", F.col("_want.name").alias("_name"), (F.col("_want.rank") - F.col("_to") + F.col("_count")).alias("_rank"))
    inside = celled.join(wanted.select(*by, "_cell").distinct(), [*by, "_cell"], "left_semi").groupBy(*by, "_cell", value).agg(F.count("*").alias("_count"))
    near = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_to", F.sum("_count").over(near)).join(wanted, [*by, "_cell"]).filter("_to >= _rank and _to - _count < _rank")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, v)).alias(k) for k in shares])


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, sample deviation and variance, range and quartiles of each group; quantiles
    are values of the data."""
    v = F.col(value)
    sums = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_dev"), F.var_samp(v).alias("variance"),
        (F.max(v) - F.min(v)).alias("value_range"), F.min(v).alias("low"), F.max(v).alias("high"),
    )
    ranks = quantiles(df, by, value, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return sums.join(ranks, by, "left").select(*by, "n", "mean", "median", "std_dev", "variance", "value_range", "low", "high", "p25", "p75")


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All most frequent values of each group, sorted, with their frequency; empty where all are unique."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("frequency"))
    best = counts.groupBy(*by).agg(F.max("frequency").alias("frequency"))
    top = counts.join(best, [*by, "frequency"]).groupBy(*by, "frequency").agg(F.sort_array(F.collect_list(value)).alias("values"))
    return top.withColumn("values", F.when(F.col("frequency") > 1, F.col("values")).otherwise(F.slice("values", 1, 0)))


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Index of the first bound that is not below the value; the number of bounds beyond the last."""
    return reduce(lambda c, ib: c.when(value <= ib[1], ib[0]), enumerate(bounds), F.when(F.lit(False), -1)).otherwise(len(bounds))
