"""Numeric columns: moments, exact quantiles, histogram, normality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import float_text, is_numeric, strip
from .longform import frequencies

#: The quantiles reported.
QUANTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
BINS = 10


def typed(long: DataFrame) -> DataFrame:
    """Cells with ``blank`` and with ``x``, the number, where the value is a valid one."""
    v = F.col("stripped")  # a column of its own, so that the pattern runs once for each cell
    cells = long.withColumn("stripped", strip(F.col("value")))
    return cells.withColumn("blank", v.isNull() | (v == "")).withColumn("x", F.when(is_numeric(v), v.try_cast("double"))).drop("stripped")


def normality(n: Column, skew: Column, excess: Column) -> Column:
    """D'Agostino and Pearson's omnibus p-value by its closed form; null under 8 values or without spread."""
    enough = (n >= 8) & skew.isNotNull() & ~F.isnan(skew)
    n = F.when(enough, n.cast("double"))
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    ratio = (1 - 2 / a) / F.when(denominator != 0, F.abs(denominator))
    z2 = (1 - 2 / (9 * a) - F.signum(denominator) * F.pow(ratio, F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


def numeric_profile(long: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """One row a column: counts, min, max, mean, stddev, median, quantiles, gaussian_pvalue.

    Moments merge partial sums of squared deviations; quantiles interpolate on (n - 1) p and come from
    exact_quantiles over the frequencies (made here unless given), so that no column meets in one task.
    """
    cells = typed(long)
    out = cells.groupBy("col", "ordinal").agg(
        F.count("*").alias("count"), F.count_if("blank").alias("null_count"), F.count("x").alias("valid_count"), F.count_if(~F.col("blank") & F.col("x").isNull()).alias("invalid_count"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("excess"),
    )
    found = exact_quantiles(frequencies(long) if freq is None else freq).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("name", "quantile"))).alias("quantiles"))
    out = out.join(F.broadcast(found), "col", "left")  # a row a column
    return out.select("col", "ordinal", "count", "null_count", "valid_count", "invalid_count", "min", "max", "mean", "stddev", F.col("quantiles")["p50"].alias("median"), "quantiles", normality(F.col("valid_count"), F.col("skew"), F.col("excess")).alias("gaussian_pvalue"))


def exact_quantiles(freq: DataFrame, wanted: dict[str, float] | None = None, ranges: int = 64) -> DataFrame:
    """(col, name, quantile) for columns of any number of distinct values.

    ``percentile`` holds a column's distinct values in one task; this deals them to ranges whose bounds
    come from a sketch, counts what lies below each range, and numbers values inside their range only.
    The bounds affect balance, not results.
    """
    from pyspark.sql import Window

    wanted = wanted or QUANTILES
    x = typed(freq).where("x is not null").groupBy("col", "x").agg(F.sum("cnt").alias("cnt"))
    bounds = x.groupBy("col").agg(F.percentile_approx("x", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("bounds"))
    x = x.join(F.broadcast(bounds), "col").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("x")))).drop("bounds")  # a row a column
    totals = x.groupBy("col", "range").agg(F.sum("cnt").alias("here"))
    by_range = Window.partitionBy("col").orderBy("range")
    below = totals.withColumn("below", F.sum("here").over(by_range) - F.col("here")).withColumn("n", F.sum("here").over(Window.partitionBy("col")))
    asks = F.array(*(F.struct(F.lit(k).alias("name"), ((F.col("n") - 1) * p).alias("at")) for k, p in wanted.items()))
    holds = lambda at, first, last: ((first <= F.floor(at)) & (F.floor(at) <= last)) | ((first <= F.ceil(at)) & (F.ceil(at) <= last))
    # only ranges that hold a rank asked for are put in order, and only values that hold one are kept
    below = below.withColumn("asks", F.filter(asks, lambda a: holds(a["at"], F.col("below"), F.col("below") + F.col("here") - 1))).where(F.size("asks") > 0).drop("here", "n")
    last = F.sum("cnt").over(Window.partitionBy("col", "range").orderBy("x")) + F.col("below") - 1
    placed = x.join(F.broadcast(below), ["col", "range"]).withColumn("last", last).withColumn("first", F.col("last") - F.col("cnt") + 1)
    found = placed.withColumn("ask", F.explode(F.filter("asks", lambda a: holds(a["at"], F.col("first"), F.col("last"))))).withColumn("at", F.col("ask.at"))
    inside = lambda place: (F.col("first") <= place) & (place <= F.col("last"))
    both = found.groupBy("col", "ask.name").agg(F.max(F.when(inside(F.floor("at")), F.col("x"))).alias("a"), F.max(F.when(inside(F.ceil("at")), F.col("x"))).alias("b"), F.max("at").alias("at"))
    return both.select("col", "name", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def histogram(freq: DataFrame, bins: int = BINS) -> DataFrame:
    """(col, bin, cnt): equal widths, the last bin closed, empty bins left out; equal labels merge."""
    x = typed(freq).where("x is not null").select("col", "x", "cnt")
    ends = x.groupBy("col").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    x = x.join(F.broadcast(ends), "col")  # a row a column
    index = F.when(F.col("x") == F.col("hi"), bins - 1).otherwise(F.floor((F.col("x") - F.col("lo")) / width))
    start = F.col("lo") + index * width
    two = lambda c: F.format_string("%.2f", c)
    label = F.when(F.col("lo") == F.col("hi"), float_text(F.col("lo"))).otherwise(F.concat(two(start), F.lit("-"), two(start + width)))
    return x.select("col", label.alias("bin"), "cnt").groupBy("col", "bin").agg(F.sum("cnt").alias("cnt"))
