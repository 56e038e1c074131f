"""Semantic type inference: class shares of a column's first values decide its type."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.kernels import INFERRED_DATES, breaks_money, date_format, has_symbol, is_alpha, is_money, is_numeric, money_like, numeric_like, parse_date, strip, value_class, wrong_decimals
from .longform import ROW_ID, first_values


def sample_counts(long: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row a column: how many of its first values fall in each class, and what they violate."""
    v = F.col("value")
    cells = first_values(long, t.sample_size).withColumn("class", value_class(v)).withColumn("fmt", F.when(F.col("class") == "date", date_format(v)))
    formats = cells.where("fmt is not null").groupBy("col", "fmt").agg(F.count("*").alias("k"), F.min(ROW_ID).alias("seen"))
    formats = formats.groupBy("col").agg(F.max_by("fmt", F.struct("k", -F.col("seen"))).alias("main_format"), (F.sum("k") - F.max("k")).alias("other_formats"))
    n = lambda c: F.count_if(c)
    out = cells.groupBy("col").agg(
        F.count("*").alias("n"), *(n(F.col("class") == k).alias(f"n_{k}") for k in ("date", "money", "numeric", "alpha")),
        n(has_symbol(v)).alias("symbols"), F.bool_or(wrong_decimals(v)).alias("odd_decimals"), n(breaks_money(v)).alias("money_violations"),
        n(is_numeric(v) | numeric_like(v)).alias("as_numeric"), n(is_money(v) | money_like(v)).alias("as_money"), n(is_alpha(v)).alias("as_alpha"), n(date_format(v).isNotNull()).alias("as_date"),
        n(~(is_numeric(v) | is_money(v) | date_format(v).isNotNull())).alias("as_text"),
    )
    return out.join(formats, "col", "left")


def shares() -> dict[str, Column]:
    return {k: F.col(f"n_{k}") / F.col("n") for k in ("date", "money", "numeric", "alpha")}


def leaderless(t: Thresholds) -> Column:
    """No class dominates and at least two are present."""
    present = sum((F.when(s >= t.present, 1).otherwise(0) for s in shares().values()), F.lit(0))
    return (F.greatest(*shares().values()) < t.dominant) & (present > 1)


def decide(t: Thresholds = Thresholds()) -> Column:
    """The type from the counts; null where numbers are present but fall short and nothing else leads."""
    n, total = F.col("n"), F.col("n") + F.col("null_count")
    share = shares()
    numbers = share["money"] + share["numeric"]
    code = (total >= t.code_least) & ((F.col("cardinality_ratio") <= t.code_ratio) | ((F.col("distinct_count") <= t.code_distinct) & (total >= t.code_distinct_least)))
    hints = (F.col("symbols") > 0) | F.col("odd_decimals")
    amount = F.when(share["money"] >= t.dominant, "money").when((share["money"] > 0) & hints, F.when(share["numeric"] > 0, "mixed").otherwise("money")).otherwise("numeric")
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "unknown")
        .when(leaderless(t), "mixed")
        .when(share["date"] >= t.dominant, "date")
        .when((numbers > 0) & (numbers >= t.dominant), amount)
        .when(numbers > 0, F.lit(None).cast("string"))
        .when(share["alpha"] >= t.dominant, F.when(code, "code").otherwise("alpha"))
        .otherwise(F.when(code, "code").otherwise("varchar"))
    )


def infer_types(long: DataFrame, freq: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row a column: type (null in the documented hole), detected_format, null_count,
    distinct_count, cardinality_ratio, error_count, warning_count, confidence."""
    v = strip(F.col("value"))
    base = freq.withColumn("v", F.when(v != "", v)).groupBy("col", "ordinal").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"), F.count_distinct("v").alias("distinct_count"))
    rows = base.join(F.broadcast(sample_counts(long, t)), "col", "left")  # a row a column
    rows = rows.withColumn("cardinality_ratio", F.when(F.col("n") > 0, F.col("distinct_count") / (F.col("n") + F.col("null_count"))).otherwise(0.0))
    rows = rows.withColumn("type", decide(t))
    # a column called mixed for want of any leading class has no violations counted
    by_money = (F.col("type") == "money") | ((F.col("type") == "mixed") & ~leaderless(t))
    errors = F.when(by_money, F.col("money_violations")).when(F.col("type") == "numeric", F.col("symbols")).otherwise(0)
    matches = F.when(F.col("type") == "numeric", F.col("as_numeric")).when(F.col("type") == "money", F.col("as_money")).when(F.col("type") == "date", F.col("as_date")).when(F.col("type") == "alpha", F.col("as_alpha")).when(F.col("type").isin("varchar", "code"), F.col("as_text")).when(F.col("type") == "mixed", F.floor(F.col("n") * 0.6)).otherwise(0)
    date = F.col("type") == "date"
    return rows.select(
        "col", "ordinal", "type", F.when(date, F.col("main_format")).alias("detected_format"), "null_count", "distinct_count", "cardinality_ratio", F.coalesce(errors, F.lit(0)).cast("long").alias("error_count"),
        F.when(date, F.col("other_formats")).otherwise(0).cast("long").alias("warning_count"), F.when(F.col("n") > 0, F.coalesce(matches, F.lit(0)) / F.col("n")).otherwise(0.0).alias("confidence"), F.coalesce("n", F.lit(0)).alias("sampled"),
    )


def out_of_range_years(long: DataFrame, t: Thresholds = Thresholds(), last_year: int | None = None) -> DataFrame:
    """(col, out_of_range_count): dates of the first values whose year is out of range."""
    last_year = last_year or datetime.date.today().year + 1
    year = F.year(parse_date(F.col("value"), date_format(F.col("value")), INFERRED_DATES))
    return first_values(long, t.sample_size).groupBy("col").agg(F.count_if(~year.between(t.first_year, last_year)).alias("out_of_range_count"))


def format_errors(types: DataFrame) -> DataFrame:
    """(code, column, count, is_warning): E_<TYPE>_FORMAT and W_<TYPE>_FORMAT with their counts."""
    kinds = F.explode(F.array(F.struct(F.lit("E").alias("p"), F.col("error_count").alias("n")), F.struct(F.lit("W").alias("p"), F.col("warning_count").alias("n"))))
    rows = types.select("col", "type", kinds.alias("k")).where("k.n > 0 and type is not null")
    return rows.select(F.concat("k.p", F.lit("_"), F.upper("type"), F.lit("_FORMAT")).alias("code"), F.col("col").alias("column"), F.col("k.n").alias("count"), (F.col("k.p") == "W").alias("is_warning"))
