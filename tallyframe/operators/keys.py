"""Candidate keys and duplicate groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from .longform import ROW_ID, with_row_id


def key_score(distinct: Column, nulls: Column, total: Column) -> Column:
    """Distinct share times non-null share; 0 without rows."""
    return F.when(total > 0, distinct / total * (1 - nulls / total)).otherwise(0.0)


def column_stats(counts: DataFrame) -> DataFrame:
    """Key statistics from distinct counts: (columns, distinct_ratio, null_ratio_sum, score, invalid)."""
    total = F.col("total_count")
    return counts.select(
        F.array("col").alias("columns"), F.when(total > 0, F.col("distinct_count") / total).otherwise(0.0).alias("distinct_ratio"), F.when(total > 0, F.col("null_count") / total).otherwise(0.0).alias("null_ratio_sum"),
        key_score(F.col("distinct_count"), F.col("null_count"), total).alias("score"), F.lit(0).cast("long").alias("invalid_count"), "ordinal", (total - F.col("null_count") - F.col("distinct_count")).alias("estimated_duplicates"),
    )


def suggest_keys(counts: DataFrame, compound: DataFrame | None = None, t: Thresholds = Thresholds(), max_null_ratio: float = 1.0) -> DataFrame:
    """The best candidate keys: singles by ratio and score, compounds by score; ties by column order."""
    stats = column_stats(counts).where((F.col("distinct_ratio") >= t.key_distinct_ratio) & (F.col("score") >= t.key_score))
    if compound is not None:
        stats = stats.unionByName(compound.where(F.col("score") >= t.key_score), allowMissingColumns=True)
    why = F.concat(F.format_string("%.1f", 100 * F.col("distinct_ratio")), F.lit("% distinct, "), F.format_string("%.1f", 100 * F.col("null_ratio_sum")), F.lit("% null"))
    return stats.where(F.col("null_ratio_sum") <= max_null_ratio).withColumn("explanation", why).orderBy(F.desc("score"), "invalid_count", "ordinal", F.size("columns")).limit(t.keys)


def strict_keys(counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Single columns only: at least 95 % distinct (of non-null values) and a score of 0.9."""
    stats = column_stats(counts.withColumn("pct", 100 * F.col("distinct_ratio")).where(F.col("pct") >= t.strict_key_pct))
    return stats.where(F.col("score") >= t.strict_key_score).orderBy(F.desc("score"), "invalid_count", "ordinal").limit(t.keys)


COMPOUND = "columns array<string>, distinct_ratio double, null_ratio_sum double, score double, invalid_count long, ordinal int, estimated_duplicates long"


def _cell(name: str) -> Column:
    text = F.col(f"`{name}`").cast("string")
    return F.when(text != "", text)


def _count_keys(df: DataFrame, combos: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """(distinct keys, rows without a null part) of each combination, by one shuffle of keys."""
    if not combos:
        return {}
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.array(*map(_cell, c)).alias("key")) for i, c in enumerate(combos))))
    long = df.select(keys.alias("k")).where(~F.exists("k.key", lambda x: x.isNull())).groupBy("k.i", "k.key").agg(F.count("*").alias("n"))
    found = {r.i: (r.d, r.n) for r in long.groupBy("i").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
    return {c: found.get(i, (0, 0)) for i, c in enumerate(combos)}


def _count_rows(df: DataFrame, combos: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Rows without a null part of each combination; no key moves, only patterns of nulls do."""
    if not combos:
        return {}
    names = sorted({x for c in combos for x in c})
    masks = df.groupBy(F.array(*(_cell(x).isNotNull() for x in names)).alias("there")).agg(F.count("*").alias("n"))
    there = {x: F.col("there")[i] for i, x in enumerate(names)}
    hits = F.array(*(F.when(F.forall(F.array(*(there[x] for x in c)), lambda x: x), i) for i, c in enumerate(combos)))
    found = masks.select(F.explode(F.array_compact(hits)).alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n"))
    got = {r.i: r.n for r in found.collect()}
    return {c: got.get(i, 0) for i, c in enumerate(combos)}


def compound_stats(df: DataFrame, counts: DataFrame, max_size: int = 3, t: Thresholds = Thresholds(), columns: list[str] | None = None) -> DataFrame:
    """Statistics of pairs and triples of gated columns; a combination counts rows without a null part.

    ``columns`` names the columns to combine; without it they are those with enough distinct and few null values.
    What holds a part that is unique already (a column, then a pair) is unique itself, so only its rows
    are counted and no key is made for it; the rest is one shuffle for each size. The driver reads a row
    a column and a row a combination.
    """
    rows = counts.orderBy("ordinal").collect()
    if columns is not None:
        check_columns(df, columns)
    wanted = lambda r: r.col in columns if columns is not None else r.distinct_count / r.total_count > t.compound_distinct_ratio and r.null_count / r.total_count < t.compound_null_ratio
    gated = {r.col: r for r in rows if r.total_count and wanted(r)}
    unique = {frozenset([c]) for c, r in gated.items() if r.distinct_count == r.total_count - r.null_count}
    found, sure = {}, []
    for size in range(2, max_size + 1):
        asked = []
        for combo in combinations(gated, size):
            whole = frozenset(combo)
            if any(whole - {c} in unique for c in combo):
                unique.add(whole)
                sure.append(combo)
            else:
                asked.append(combo)
        level = _count_keys(df, asked)
        unique |= {frozenset(c) for c, (distinct, n) in level.items() if distinct == n}
        found |= level
    holes = {c: [gated[x].null_count for x in c if gated[x].null_count] for c in sure}
    by_rows = _count_rows(df, [c for c in sure if len(holes[c]) > 1])
    for c in sure:
        n = by_rows[c] if c in by_rows else gated[c[0]].total_count - sum(holes[c])
        found[c] = n, n
    out = []
    for size in range(2, max_size + 1):
        for c in combinations(gated, size):
            (distinct, n), total = found[c], gated[c[0]].total_count
            if n:
                nulls, ratio = sum(gated[x].null_count / total for x in c), distinct / total
                out.append((list(c), ratio, float(nulls), ratio * max(0.0, 1 - nulls), total - n, gated[c[0]].ordinal, n - distinct))
    return df.sparkSession.createDataFrame(out, COMPOUND)


def accepted_compounds(stats: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return stats.where(F.col("distinct_ratio") > t.compound_accept)


def check_columns(df: DataFrame, keys: list[str]) -> None:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def _keyed(df: DataFrame, keys: list[str], case_sensitive: bool) -> DataFrame:
    text = lambda c: F.col(f"`{c}`").cast("string")
    value = lambda c: text(c) if case_sensitive else F.lower(text(c))
    null = [text(c).isNull() | (text(c) == "") for c in keys]
    any_null = null[0]
    for x in null[1:]:
        any_null = any_null | x
    return with_row_id(df).withColumn("__null", any_null).withColumn("__key", F.struct(*(value(c).alias(f"k{i}") for i, c in enumerate(keys))))


def duplicate_groups(df: DataFrame, keys: list[str], case_sensitive: bool = True) -> DataFrame:
    """(key, n, first_row) of keys on more than one row; keys with a null or empty part are left out."""
    check_columns(df, keys)
    rows = _keyed(df, keys, case_sensitive).where(~F.col("__null"))
    return rows.groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first_row")).where("n > 1")


def duplicate_summary(df: DataFrame, keys: list[str], case_sensitive: bool = True) -> DataFrame:
    """One row: total_rows, null_key_count, duplicate_count (keys), duplicate_rows (in groups),
    surplus_rows (beyond the first), duplicate_pct of all rows, has_duplicates."""
    check_columns(df, keys)
    rows = _keyed(df, keys, case_sensitive)
    groups = rows.groupBy("__null", "__key").agg(F.count("*").alias("n"))
    more = ~F.col("__null") & (F.col("n") > 1)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = groups.agg(n(F.col("n")).alias("total_rows"), n(F.when(F.col("__null"), F.col("n"))).alias("null_key_count"), F.count_if(more).alias("duplicate_count"), n(F.when(more, F.col("n"))).alias("duplicate_rows"), n(F.when(more, F.col("n") - 1)).alias("surplus_rows"))
    return out.withColumn("duplicate_pct", F.when(F.col("total_rows") > 0, 100.0 * F.col("surplus_rows") / F.col("total_rows")).otherwise(0.0)).withColumn("has_duplicates", F.col("duplicate_count") > 0)


def top_duplicates(df: DataFrame, keys: list[str], groups: int = 10, rows_each: int = 10, case_sensitive: bool = True) -> DataFrame:
    """The largest groups with their first row numbers and a sample row; ties by first appearance."""
    best = duplicate_groups(df, keys, case_sensitive).orderBy(F.desc("n"), "first_row").limit(groups)
    rows = _keyed(df, keys, case_sensitive).where(~F.col("__null"))
    sample = [c for c in df.columns if c != ROW_ID]
    hits = rows.join(F.broadcast(best), rows["__key"] == best["key"])  # at most ``groups`` rows
    near = hits.withColumn("__part", F.spark_partition_id()).withColumn("rank", F.row_number().over(Window.partitionBy("key", "__part").orderBy(ROW_ID))).where(F.col("rank") <= rows_each)
    return near.groupBy("key", "n", "first_row").agg(F.slice(F.sort_array(F.collect_list(ROW_ID)), 1, rows_each).alias("row_numbers"), F.min_by(F.to_json(F.struct(*sample)), ROW_ID).alias("sample_row")).select(F.array_join(F.array(*(F.col(f"key.k{i}") for i in range(len(keys)))), "|").alias("key_value"), "n", "row_numbers", "sample_row").orderBy(F.desc("n"), F.element_at("row_numbers", 1))
