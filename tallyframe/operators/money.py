"""Money columns: exactly two decimals, no symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import is_money, strip

LABELS = ["dollar_sign", "comma", "parentheses", "wrong_decimals"]


def labelled(freq: DataFrame) -> DataFrame:
    """Frequencies with v, ok and one flag for each kind of violation of an invalid value."""
    v = F.col("v")
    f = freq.withColumn("v", strip(F.col("value"))).withColumn("v", F.when(v != "", v))
    bad = v.isNotNull() & ~is_money(v)
    bare = F.translate(v, "$,()", "")
    decimals = F.when(v.contains("."), (F.size(F.split(bare, "\\.")) == 2) & (F.length(F.element_at(F.split(bare, "\\."), -1)) != 2)).otherwise(True)
    flags = {"dollar_sign": v.contains("$"), "comma": v.contains(","), "parentheses": v.rlike(r"[()]"), "wrong_decimals": decimals}
    f = f.withColumn("ok", v.isNotNull() & is_money(v)).withColumn("bad", bad)
    for name, flag in flags.items():
        f = f.withColumn(name, F.coalesce(F.col("bad") & flag, F.lit(False)))
    return f


def money_profile(freq: DataFrame) -> DataFrame:
    """One row a column: counts, the two flags, min and max of valid values, violations by kind."""
    f = labelled(freq)
    n = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("cnt"))), F.lit(0))
    x = F.when(F.col("ok"), F.expr("try_cast(v AS DOUBLE)"))
    out = f.groupBy("col", "ordinal").agg(F.sum("cnt").alias("total_count"), n(F.col("v").isNull()).alias("null_count"), n(F.col("ok")).alias("valid_count"), n(F.col("bad")).alias("invalid_count"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), *(n(F.col(k)).alias(k) for k in LABELS))
    pct = lambda c: F.when(F.col("total_count") > 0, 100.0 * F.col(c) / F.col("total_count")).otherwise(0.0)
    symbols = F.col("dollar_sign") + F.col("comma") + F.col("parentheses")
    violations = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.array(*LABELS)), lambda k, v: v > 0)
    return out.withColumn("two_decimal_ok", F.col("wrong_decimals") == 0).withColumn("disallowed_symbols_found", symbols > 0).withColumn("violations", violations).withColumn("valid_pct", pct("valid_count")).withColumn("invalid_pct", pct("invalid_count")).withColumn("null_pct", pct("null_count"))


def violation_examples(long: DataFrame, n: int = 3) -> DataFrame:
    """(col, kind, rank, example): the first n cells in row order of each kind. A value without a point
    counts among wrong_decimals but is no example of it."""
    f = labelled(long)
    kinds = F.explode(F.array_compact(F.array(*(F.when(F.col(k) & (F.lit(k != "wrong_decimals") | F.col("v").contains(".")), F.lit(k)) for k in LABELS))))
    cells = f.withColumn("kind", kinds).withColumn("salt", F.pmod(F.xxhash64("_row_id"), F.lit(64)))
    near = cells.withColumn("rank", F.row_number().over(Window.partitionBy("col", "kind", "salt").orderBy("_row_id"))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("col", "kind").orderBy("_row_id"))).where(F.col("rank") <= n).select("col", "kind", "rank", F.col("v").alias("example"))
