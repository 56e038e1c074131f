"""Exact distinct counts and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import strip


def normalised(freq: DataFrame, case_sensitive: bool = True, trim: bool = True) -> DataFrame:
    """Frequencies as the counter sees them: null and '' are null, the literal "" (two quotes) is an
    empty value; trimming comes after the null test, so blanks become the distinct value ''."""
    raw = F.col("value")
    v = strip(raw) if trim else raw
    v = v if case_sensitive else F.lower(v)
    kind = F.when(raw.isNull() | (raw == ""), "null").when(raw == '""', "empty").otherwise("value")
    return freq.withColumn("kind", kind).withColumn("value", F.when(F.col("kind") == "value", v)).groupBy("col", "ordinal", "kind", "value").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))


def distinct_counts(freq: DataFrame, **options) -> DataFrame:
    """(col, total_count, null_count, empty_count, distinct_count, distinct_ratio, duplicate_count)."""
    f = normalised(freq, **options)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("cnt"))), F.lit(0))
    out = f.groupBy("col", "ordinal").agg(F.sum("cnt").alias("total_count"), n("null").alias("null_count"), n("empty").alias("empty_count"), F.count_if(F.col("kind") == "value").alias("distinct_count"))
    rest = F.col("total_count") - F.col("null_count")
    return out.withColumn("distinct_ratio", F.when(rest > 0, F.col("distinct_count") / rest).otherwise(0.0)).withColumn("duplicate_count", F.greatest(F.lit(0), rest - F.col("distinct_count")))
