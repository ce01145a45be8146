"""Chart statistics: ranges, stacks, error bars, trends and ticks as grouped and windowed aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: colors of series that name none, in turn.
PALETTE = ("#4472c4", "#ed7d31", "#a5a5a5", "#ffc000", "#5b9bd5", "#70ad47")


def finite(value: Column) -> Column:
    """A number; anything else, NaN and the infinities are 0."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def chart_range(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Least and greatest value with 0 among them, one apart where they are equal."""
    low, high = F.least(F.lit(0.0), F.min(value)), F.greatest(F.lit(0.0), F.max(value))
    return points.groupBy(*by).agg(low.alias("low"), F.when(low == high, low + 1).otherwise(high).alias("high"))


def stack_percent(points: DataFrame, category: list[str], value: str = "value") -> DataFrame:
    """Add ``total`` and ``percent``: positives by the positives of their category, negatives by the
    negatives; a total of 0 counts as 1."""
    w = Window.partitionBy(*category)
    v = F.col(value)
    up = F.sum(F.when(v > 0, v).otherwise(0.0)).over(w)
    down = F.sum(F.when(v < 0, -v).otherwise(0.0)).over(w)
    base = F.when(v < 0, down).otherwise(up)
    return points.withColumns({"total": F.sum(v).over(w), "percent": 100 * v / F.when(base == 0, 1.0).otherwise(base)})


def error_bars(points: DataFrame, series: list[str], kind: str, amount: float = 1.0, value: str = "value") -> DataFrame:
    """Add ``error``: fixed, percent of the value, standard deviations, or the standard error of the series
    (population deviation; the amount doesn't scale it)."""
    w = Window.partitionBy(*series)
    sigma = F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0))
    made = {"fixed": F.lit(float(amount)), "percentage": F.abs(F.col(value)) * (amount / 100), "stddev": sigma * amount, "stderr": sigma / F.sqrt(F.count(value).over(w))}
    if kind not in made:
        raise ValueError(f"error bars are {', '.join(made)}")
    return points.withColumn("error", made[kind])


def linear_trend(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(slope, intercept) by least squares; one x alone has slope 0 and the mean as its intercept; none, 0 and 0."""
    return points.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y), F.lit(0.0)).alias("intercept"))


def exponential_trend(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(factor, rate) of y = factor * exp(rate * x), fitted to the logarithms of positive points at their own
    x; groups with fewer than two such points are left out."""
    up = points.where(F.col(y) > 0).withColumn("_l", F.log(y))
    fit = up.groupBy(*by).agg(F.count("*").alias("_n"), F.coalesce(F.regr_slope("_l", x), F.lit(0.0)).alias("rate"), F.coalesce(F.regr_intercept("_l", x), F.avg("_l")).alias("_a"))
    return fit.where("_n >= 2").select(*by, F.exp("_a").alias("factor"), "rate")


def polynomial_trend(points: DataFrame, by: list[str], order: int = 2, x: str = "x", y: str = "y") -> DataFrame:
    """``coefficients`` from the constant up, by normal equations; order 1 to 6. Null with fewer than order + 1
    points, or if a pivot is under 1e-12. Only the power sums of a group leave the aggregation."""
    order = min(max(order, 1), 6)
    powers = [F.sum(F.pow(F.col(x).cast("double"), F.lit(k))).alias(f"_s{k}") for k in range(2 * order + 1)]
    sides = [F.sum(F.col(y) * F.pow(F.col(x).cast("double"), F.lit(k))).alias(f"_t{k}") for k in range(order + 1)]
    sums = points.groupBy(*by).agg(*powers, *sides)

    def solve(s: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([_solve(a, b) for a, b in zip(s.to_pylist(), t.to_pylist(), strict=True)], pa.list_(pa.float64()))

    run = F.arrow_udf(solve, "array<double>")
    return sums.select(*by, run(F.array(*[f"_s{k}" for k in range(2 * order + 1)]), F.array(*[f"_t{k}" for k in range(order + 1)])).alias("coefficients"))


def _solve(s: list[float], t: list[float], least: float = 1e-12) -> list[float] | None:
    n = len(t)
    if s[0] is None or s[0] < n:
        return None
    m = np.array([[s[i + j] for j in range(n)] + [t[i]] for i in range(n)])
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[p, k]) < least:
            return None
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        for i in range(n):
            if i != k:
                m[i] -= m[i, k] * m[k]
    return m[:, n].tolist()


def moving_average(points: DataFrame, series: list[str], order: list[str], period: int = 2, value: str = "value") -> DataFrame:
    """Add ``moving_avg`` over the row and up to ``period - 1`` before it."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(1 - max(period, 1), 0)
    return points.withColumn("moving_avg", F.avg(value).over(w))


def axis_ticks(ranges: DataFrame, by: list[str], unit: Column | None = None) -> DataFrame:
    """One row (tick_ix, tick) a tick between ``low`` and ``high``: multiples of ``unit`` from the low end (as
    many as half-even rounding of the span says, within the range), else six from high to low."""
    low, high = F.col("low"), F.col("high")
    if unit is None:
        steps = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: high - (high - low) * i / 5)
    else:
        n = F.bround((high - low) / unit).cast("int")
        steps = F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: low + unit * i), lambda t: (t >= low) & (t <= high))
    return ranges.select(*by, F.posexplode(steps).alias("tick_ix", "tick"))


def runs_of(rows: DataFrame, series: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Add ``run``: consecutive rows that agree in ``same`` share a number, from 0."""
    w = Window.partitionBy(*series).orderBy(*order)
    key = F.struct(*same)
    return rows.withColumn("run", F.sum(F.when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)).over(w) - 1)


def dense_cache(points: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Sparse (idx, value) points as an array of ``length`` with null gaps; points beyond it are left out."""
    maps = points.where(F.col("idx").between(0, F.col(length) - 1)).groupBy(*by, length).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.col(length) - 1), lambda i: F.try_element_at("_m", i))
    return maps.select(*by, at.alias("values"))


def format_number(value: Column, code: Column) -> Column:
    """A number in the common spreadsheet formats: percent, thousands and fixed decimals, else General with
    at most six significant digits."""

    def run(values: pa.Array, codes: pa.Array) -> pa.Array:
        return pa.array([_formatted(v, c) for v, c in zip(values.to_pylist(), codes.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(value.cast("double"), code)


def _formatted(v: float | None, code: str | None) -> str | None:
    if v is None:
        return None
    code = (code or "General").split(";")[0]
    if not any(c in code for c in "0#"):
        return f"{v:g}"
    percent, comma = "%" in code, "," in code
    decimals = sum(c in "0#" for c in code.partition(".")[2])
    return f"{v * 100 if percent else v:{',' if comma else ''}.{decimals}f}{'%' if percent else ''}"


def data_label(flags: Column, series: Column, category: Column, percent: Column, value: Column, separator: str = ", ") -> Column:
    """The parts that ``flags`` (a struct of booleans series, category, percent, value) shows, joined."""
    shown = [F.when(flags[n], v) for n, v in (("series", series), ("category", category), ("percent", percent), ("value", value))]
    return F.concat_ws(separator, *shown)


def describe_chart(points: DataFrame, by: list[str]) -> DataFrame:
    """``description``: each series with its values in the order of the categories."""
    w = points.groupBy(*by, "series_ix", "series_name").agg(F.sort_array(F.collect_list(F.struct("idx", "category", "value"))).alias("_p"))
    line = F.concat(F.col("series_name"), F.lit(": "), F.array_join(F.transform("_p", lambda p: F.concat(p["category"], F.lit(" "), p["value"].cast("string"))), ", "))
    return w.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("series_ix", line.alias("l")))), lambda s: s["l"]), "; ").alias("description"))


