"""String and code columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import CHARACTER_CLASSES, non_ascii, strip


def string_profile(freq: DataFrame) -> DataFrame:
    """One row a column: counts, lengths, character classes, non-ASCII flag. Values are stripped first."""
    v = strip(F.col("value"))
    f = freq.withColumn("v", F.when(v != "", v)).withColumn("n", F.length("v"))
    classes = [F.when(F.bool_or(F.col("v").rlike(pattern)), F.lit(name)) for name, pattern in sorted(CHARACTER_CLASSES.items())]
    valid = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("cnt"))), F.lit(0))
    return f.groupBy("col", "ordinal").agg(
        F.sum("cnt").alias("count"), (F.sum("cnt") - valid).alias("null_count"), valid.alias("valid_count"), F.min("n").alias("min_length"), F.max("n").alias("max_length"),
        (F.sum(F.col("n") * F.col("cnt")) / F.sum(F.when(F.col("v").isNotNull(), F.col("cnt")))).alias("avg_length"), F.array_compact(F.array(*classes)).alias("character_types"), F.coalesce(F.bool_or(non_ascii(F.col("v"))), F.lit(False)).alias("has_non_ascii"),
    )


def code_profile(freq: DataFrame) -> DataFrame:
    """One row a column: distinct stripped values, their ratio to all rows (nulls too), lengths."""
    v = strip(F.col("value"))
    f = freq.withColumn("v", F.when(v != "", v)).groupBy("col", "ordinal", "v").agg(F.sum("cnt").alias("cnt"))
    n = F.length("v")
    valid = F.sum(F.when(F.col("v").isNotNull(), F.col("cnt")))
    return f.groupBy("col", "ordinal").agg(F.sum("cnt").alias("count"), F.coalesce(valid, F.lit(0)).alias("valid_count"), F.count("v").alias("distinct_count"), (F.count("v") / F.sum("cnt")).alias("cardinality_ratio"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), (F.sum(n * F.col("cnt")) / valid).alias("avg_length"))
