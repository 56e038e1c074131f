"""The long form of a table and its frequencies: one shuffle that most operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import float_text, strip

ROW_ID = "_row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """Rows numbered in reading order, not contiguously; a number already there is kept."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder with its rows numbered as they stand: files by name, then rows.

    Spark reads the largest files of a folder first, so numbers by partition are not in that order.
    """
    from pyspark.sql import Window

    df = spark.read.parquet(path)
    rows = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    files = rows.select("__path").distinct().withColumn("__file", F.row_number().over(Window.orderBy("__path")).cast("long"))  # a row a file
    return rows.join(F.broadcast(files), "__path").select(*(F.col(f"`{c}`") for c in df.columns), (F.shiftleft("__file", 40) + F.col("__at")).alias(ROW_ID))


def to_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, ordinal, _row_id, value): a row for each cell, values as strings; of doubles, plain ones."""
    columns = columns or [c for c in df.columns if c != ROW_ID]
    rows = with_row_id(df)
    text = lambda c: float_text(F.col(f"`{c}`")) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(f"`{c}`").cast("string")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.lit(i).alias("ordinal"), text(c).alias("value")) for i, c in enumerate(columns))))
    return rows.select(ROW_ID, cells.alias("cell")).select("cell.col", "cell.ordinal", ROW_ID, "cell.value")


def frequencies(long: DataFrame) -> DataFrame:
    """(col, ordinal, value, cnt, first_row): exact, nulls included."""
    return long.groupBy("col", "ordinal", "value").agg(F.count("*").alias("cnt"), F.min(ROW_ID).alias("first_row"))


def stripped(freq: DataFrame) -> DataFrame:
    """Frequencies of values without outer white space; blank ones are null."""
    v = strip(F.col("value"))
    return freq.withColumn("value", F.when(v != "", v)).groupBy("col", "ordinal", "value").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))


def top_values(freq: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values of each column, ties by first appearance: (col, rank, value, cnt).

    Each task first keeps its own best n, so that a column of any size is no task's burden.
    """
    from pyspark.sql import Window

    order = [F.desc("cnt"), F.asc("first_row")]
    salted = freq.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("col", "salt").orderBy(*order))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(*order))).where(F.col("rank") <= n).select("col", "rank", "value", "cnt")


def top_list(freq: DataFrame, n: int = 10) -> DataFrame:
    """(col, top_values): an array of (value, count)."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "value", F.col("cnt").alias("count"))))
    return top_values(freq, n).groupBy("col").agg(F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))


def first_values(long: DataFrame, n: int = 100) -> DataFrame:
    """The first n non-blank values of each column in row order, stripped: (col, ordinal, _row_id, value).

    Row numbers are counted by their number of binary digits first (a hash aggregate, a row for each
    column and length); only rows up to the length at which a column has its n values are then sorted.
    """
    from pyspark.sql import Window

    filled = long.where(F.col("value").rlike(r"(?U)\S"))
    digits = F.when(F.col(ROW_ID) < 0, -F.length(F.bin(-F.col(ROW_ID)))).otherwise(F.length(F.bin(F.col(ROW_ID))))
    counts = filled.groupBy("col", digits.alias("digits")).agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("col").orderBy("digits")) - F.col("k")
    most = counts.withColumn("before", before).where(F.col("before") < n).groupBy("col").agg(F.max("digits").alias("most"))
    rows = filled.join(F.broadcast(most), "col").where(digits <= F.col("most")).withColumn("value", strip(F.col("value")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(ROW_ID), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("col", "salt").orderBy(ROW_ID))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(ROW_ID))).where(F.col("rank") <= n).select("col", "ordinal", ROW_ID, "value")
