"""Frequencies that grow with a stream: the incremental form of the counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.longform import frequencies, to_long


def streaming_frequencies(stream: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, cnt) of a stream, kept in the state store; write it in update or complete mode."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    return stream.select(cells.alias("cell")).groupBy("cell.col", "cell.value").agg(F.count("*").alias("cnt"))


def merge_frequencies(*parts: DataFrame) -> DataFrame:
    """Frequencies of several batches as one; equal to those of all rows at once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("col", "ordinal", "value").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))


def batch_writer(path: str):
    """For foreachBatch: each batch's frequencies under its own number, so that a repeat replaces it."""
    def write(batch: DataFrame, number: int) -> None:
        frequencies(to_long(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
