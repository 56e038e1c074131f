"""Date columns: format vote, validity, range and distributions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import CHECKED_DATES, DAY_FIRST, date_format, parse_date, strip

LEVELS = {"month": "yyyy-MM", "year": "yyyy", "weekday": "EEEE"}


def _values(freq: DataFrame) -> DataFrame:
    v = strip(F.col("value"))
    f = freq.withColumn("v", F.when(v != "", v)).groupBy("col", "ordinal", "v").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))
    return f.withColumn("fmt", date_format(F.col("v"), CHECKED_DATES))


def format_votes(long: DataFrame) -> DataFrame:
    """(col, fmt, cnt, first_row): cells by the first format that reads them.

    DD/MM/YYYY has a vote for each cell that it reads and that comes before the column's first
    MM/DD/YYYY cell. A cell is looked at once; the vote is by rows, so it needs the long form.
    """
    v = strip(F.col("value"))
    cells = long.select("col", "_row_id", v.alias("v")).where(F.col("v") != "").withColumn("fmt", date_format(F.col("v"), CHECKED_DATES))
    votes = cells.where("fmt is not null").groupBy("col", "fmt").agg(F.count("*").alias("cnt"), F.min("_row_id").alias("first_row"))
    month_first = votes.where("fmt = 'MM/DD/YYYY'").select("col", F.col("first_row").alias("seen"))
    day = cells.where(date_format(F.col("v"), [DAY_FIRST]).isNotNull()).join(F.broadcast(month_first), "col", "left")  # a row a column
    day = day.where(F.col("seen").isNull() | (F.col("_row_id") < F.col("seen"))).groupBy("col").agg(F.lit(DAY_FIRST[0]).alias("fmt"), F.count("*").alias("cnt"), F.min("_row_id").alias("first_row"))
    return votes.union(day.select("col", "fmt", "cnt", "first_row"))


def detected_formats(long: DataFrame) -> DataFrame:
    """(col, detected_format, confidence, has_ambiguity): most votes, ties to the first seen."""
    slash = F.col("fmt").isin("MM/DD/YYYY", "DD/MM/YYYY")
    best = F.max_by("fmt", F.struct("cnt", -F.col("first_row")))
    return format_votes(long).groupBy("col").agg(best.alias("detected_format"), (F.max("cnt") / F.sum("cnt")).alias("confidence"), (F.bool_or(slash) | (F.count("*") > 1)).alias("has_ambiguity"))


def date_profile(long: DataFrame, freq: DataFrame, first_year: int = 1900, last_year: int | None = None) -> DataFrame:
    """One row a column: counts under the winning format, range, span, consistency, warnings.

    A year outside first_year .. last_year (next year if not given) is counted but still valid.
    """
    last_year = last_year or datetime.date.today().year + 1
    f = _values(freq).join(F.broadcast(detected_formats(long)), "col", "left")  # a row a column
    d = parse_date(F.col("v"), F.col("detected_format"))
    f = f.withColumn("d", d)
    n = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("cnt"))), F.lit(0))
    valid = F.col("d").isNotNull()
    out_of = valid & ~F.year("d").between(first_year, last_year)
    kinds = F.count_distinct(F.when(valid, F.col("detected_format")).otherwise(F.col("fmt")))
    out = f.groupBy("col", "ordinal").agg(
        F.sum("cnt").alias("count"), n(F.col("v").isNull()).alias("null_count"), n(valid).alias("valid_count"), n(F.col("v").isNotNull() & ~valid).alias("invalid_count"), n(out_of).alias("out_of_range_count"),
        F.first("detected_format").alias("detected_format"), F.first("confidence").alias("confidence"), F.coalesce(F.first("has_ambiguity"), F.lit(False)).alias("has_ambiguity"), kinds.alias("kinds"), F.min("d").alias("lo"), F.max("d").alias("hi"),
    )
    text = lambda c: F.date_format(c, "yyyyMMdd")
    consistent = F.when(F.col("detected_format").isNull(), False).otherwise(F.col("kinds") <= 1)
    return out.select("col", "ordinal", "count", "null_count", "valid_count", "invalid_count", "out_of_range_count", "detected_format", "confidence", "has_ambiguity", consistent.alias("format_consistent"), text("lo").alias("min_date"), text("hi").alias("max_date"), F.datediff("hi", "lo").alias("span_days"))


def date_distribution(long: DataFrame, freq: DataFrame) -> DataFrame:
    """(col, level, key, cnt): valid dates by month, year and weekday."""
    f = _values(freq).join(F.broadcast(detected_formats(long)), "col")  # a row a column
    f = f.withColumn("d", parse_date(F.col("v"), F.col("detected_format"))).where("d is not null")
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.date_format("d", p).alias("key")) for k, p in LEVELS.items())))
    return f.select("col", "cnt", keys.alias("k")).groupBy("col", "k.level", "k.key").agg(F.sum("cnt").alias("cnt"))


def range_warnings(long: DataFrame, freq: DataFrame, first_year: int = 1900, last_year: int | None = None) -> DataFrame:
    """(col, value, cnt, message) of dates whose year is out of range."""
    last_year = last_year or datetime.date.today().year + 1
    f = _values(freq).join(F.broadcast(detected_formats(long)), "col")
    f = f.withColumn("y", F.year(parse_date(F.col("v"), F.col("detected_format"))))
    side = F.when(F.col("y") < first_year, F.lit(f"< {first_year}")).when(F.col("y") > last_year, F.lit(f"> {last_year}"))
    return f.where(side.isNotNull()).select("col", F.col("v").alias("value"), "cnt", F.concat(F.lit("Date "), F.col("v"), F.lit(" has year "), side).alias("message"))
