"""The profile of a table or file: types, statistics, keys and errors from a few shared plans."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..operators import dates, errors as error_ops, infer, keys, money, numeric, strings
from ..operators.distinct import distinct_counts
from ..operators.longform import frequencies, to_long, top_list, with_row_id
from ..sources import bytes as byte_checks
from ..sources import delimited


class RunFailed(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@contextlib.contextmanager
def failing(code: str):
    """What fails inside ends the run with this code, unless it has one of its own."""
    try:
        yield
    except RunFailed:
        raise
    except Exception as bad:
        raise RunFailed(getattr(bad, "code", code), str(bad)) from bad


@dataclass
class Profile:
    """DataFrames: one row a column in ``columns``; frequencies for whatever else is asked."""

    table: DataFrame
    long: DataFrame
    freq: DataFrame
    columns: DataFrame
    candidate_keys: DataFrame
    errors: DataFrame
    totals: DataFrame
    dialect: dict = field(default_factory=dict)
    state: str = "completed"
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))

    def top_values(self, n: int = 10) -> DataFrame:
        return top_list(self.freq, n)

    def duplicates(self, key_columns: list[str], **options) -> DataFrame:
        return keys.duplicate_summary(self.table, key_columns, **options)

    def compound_keys(self, max_size: int = 3) -> DataFrame:
        """Candidate keys with pairs and triples of columns counted too."""
        counts = distinct_counts(self.freq)
        return keys.suggest_keys(counts, keys.compound_stats(self.table, counts, max_size))

    def release(self) -> None:
        """Give back what the profile keeps cached on the executors."""
        self.freq.unpersist()
        self.columns.unpersist()

    def register(self, prefix: str = "profile") -> None:
        """Temp views of the results."""
        for name in ("columns", "candidate_keys", "errors", "totals"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}_{name}")


def column_profiles(long: DataFrame, freq: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """The union of all statistics, those of other types null: one row a column.

    The per-column parts are a row for each column, so the joins between them are small.
    """
    t = config.thresholds
    spark = long.sparkSession
    # the one mid-flight collect, a row a column: what no column needs is then not planned at all
    inferred = infer.infer_types(long, freq, t)
    with failing("E_TYPE_INFERENCE_FAILED"):
        types = spark.createDataFrame(inferred.collect(), inferred.schema)
    kinds: dict[str, list[str]] = {}
    for r in types.collect():
        kinds.setdefault(r.type or "unknown", []).append(r.col)
    counts = distinct_counts(freq)

    def of_type(df: DataFrame, wanted: list[str]) -> DataFrame:
        names = [c for k in wanted for c in kinds.get(k, [])]
        return df.where(F.col("col").isin(names)) if names else spark.createDataFrame([], df.schema)

    text_kinds = ("alpha", "varchar", "code", "mixed", "unknown")
    n = numeric.numeric_profile(of_type(long, ["numeric"]), of_type(freq, ["numeric"])).select("col", F.col("valid_count").alias("n_valid"), F.col("invalid_count").alias("n_invalid"), "min", "max", "mean", "median", "stddev", "quantiles", "gaussian_pvalue")
    bins = numeric.histogram(of_type(freq, ["numeric"])).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("histogram"))
    s = strings.string_profile(of_type(freq, text_kinds)).select("col", "min_length", "max_length", "avg_length", "has_non_ascii", "character_types")
    c = strings.code_profile(of_type(freq, ["code"])).select("col", F.col("cardinality_ratio").alias("code_ratio"))
    m = money.money_profile(of_type(freq, ["money"])).select("col", F.col("valid_count").alias("m_valid"), F.col("invalid_count").alias("m_invalid"), F.col("min_value").alias("m_min"), F.col("max_value").alias("m_max"), "two_decimal_ok", "disallowed_symbols_found", "violations")
    examples = money.violation_examples(of_type(long, ["money"]), t.examples).groupBy("col", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]).alias("e")).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("kind", "e"))).alias("violation_examples"))
    d = dates.date_profile(of_type(long, ["date"]), of_type(freq, ["date"]), t.first_year).select("col", F.col("valid_count").alias("d_valid"), F.col("invalid_count").alias("d_invalid"), "out_of_range_count", F.col("detected_format").alias("d_format"), "format_consistent", "has_ambiguity", "min_date", "max_date", "span_days")
    spread = dates.date_distribution(of_type(long, ["date"]), of_type(freq, ["date"]))
    by = lambda level: F.map_from_entries(F.collect_list(F.when(F.col("level") == level, F.struct("key", "cnt"))))
    spread = spread.groupBy("col").agg(by("month").alias("by_month"), by("year").alias("by_year"), by("weekday").alias("by_weekday"))
    out = types.drop("distinct_count", "null_count").join(counts.drop("ordinal"), "col")
    needs = {"numeric": (n, bins), "money": (m, examples), "date": (d, spread), "code": (c,)}
    for part in (n, bins, s, c, m, examples, d, spread, top_list(freq.where("value is not null and value != ''"), t.top_values)):
        if any(part is x for k, parts in needs.items() if k not in kinds for x in parts):
            part = spark.createDataFrame([], part.schema)
        out = out.join(F.broadcast(part), "col", "left")
    total = F.col("total_count")
    share = lambda c: F.when(total > 0, 100.0 * F.col(c) / total).otherwise(0.0)
    return out.select(
        F.col("col").alias("name"), "ordinal", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("d_format", "detected_format").alias("detected_format"), "confidence", total.alias("row_count"), "null_count", share("null_count").alias("null_pct"),
        "distinct_count", (100.0 * F.col("distinct_ratio")).alias("distinct_pct"), "empty_count", F.coalesce("min", "m_min").alias("min"), F.coalesce("max", "m_max").alias("max"), "mean", "median", "stddev", "quantiles", "histogram", "gaussian_pvalue",
        F.coalesce("n_valid", "m_valid", "d_valid").alias("valid_count"), F.coalesce("n_invalid", "m_invalid", "d_invalid").alias("invalid_count"), "error_count", "warning_count", "out_of_range_count", "min_length", "max_length", "avg_length", "has_non_ascii", "character_types",
        "format_consistent", "has_ambiguity", "min_date", "max_date", "span_days", "by_month", "by_year", "by_weekday", "two_decimal_ok", "disallowed_symbols_found", "violations", "violation_examples", F.coalesce("code_ratio", "cardinality_ratio").alias("cardinality_ratio"), "top_values",
    ).orderBy("ordinal")


def profile_table(df: DataFrame, config: ProfileConfig = ProfileConfig(), found: DataFrame | None = None, dialect: dict | None = None) -> Profile:
    """Profile any table: cells are read as strings. ``found``: errors from reading, with code and line."""
    rows = with_row_id(df)
    long = to_long(rows)
    for token in config.null_tokens:
        long = long.withColumn("value", F.when(F.col("value") != token, F.col("value")))
    freq = frequencies(long).cache()
    columns = column_profiles(long, freq, config).cache()
    counts = distinct_counts(freq)
    warned = infer.format_errors(columns.select(F.col("name").alias("col"), "type", "error_count", "warning_count"))
    late = columns.where("out_of_range_count > 0").select(F.lit("W_DATE_RANGE").alias("code"), F.col("name").alias("column"), F.col("out_of_range_count").alias("count"))
    mixed = columns.where("type = 'date' and not format_consistent").select(F.lit("E_DATE_MIXED_FORMAT").alias("code"), F.col("name").alias("column"), F.col("invalid_count").alias("count"))
    every = warned.select("code", "column", "count").union(late).union(mixed).select("code", "column", "count", F.lit(None).cast("string").alias("message"), F.lit(None).cast("long").alias("line"))
    if found is not None:
        every = every.union(found.select("code", F.lit(None).cast("string"), F.lit(1).cast("long"), "message", "line"))
    totals = columns.agg(F.max("row_count").alias("total_rows"), F.count("*").alias("total_columns"), F.sum("null_count").alias("total_nulls"), F.sum("distinct_count").alias("total_distinct"))
    return Profile(rows, long, freq, columns, keys.suggest_keys(counts, t=config.thresholds), error_ops.rollup(every), totals, dialect or {})


def profile_file(spark: SparkSession, path: str, config: ProfileConfig = ProfileConfig(), progress: Callable[[int, str], None] = lambda share, step: None) -> Profile:
    """Check, read and profile a delimited file; raises RunFailed with the code of what ends a run."""
    progress(0, "started")
    with failing("E_PROCESSING_FAILED"):
        report = byte_checks.file_report(spark, path).collect()  # a row a file
    progress(10, "checked")
    for r in report:
        if r.error_code:
            raise RunFailed(r.error_code, f"{r.path} is no gzip file")
        if not r.is_valid:
            raise RunFailed("E_UTF8_INVALID", f"byte {r.offset} of {r.path}: {r.reason}")
    first = min((r.path for r in report), default=path)
    with failing("E_CSV_PARSE_FAILED"):
        table, found, dialect = delimited.read_delimited(spark, first if len(report) == 1 else path, config.delimiter, config.quoted, config.has_header)
    progress(30, "read")
    notes = []
    if config.delimiter and dialect["delimiter"] != config.delimiter and dialect["delimiter_confidence"] > 0.7:
        notes.append(("W_DELIMITER_MISMATCH", f"declared {config.delimiter!r}, detected {dialect['delimiter']!r}"))
    if config.quoted is not None and dialect["quoted"] != config.quoted and dialect["quoted_confidence"] > 0.7:
        notes.append(("W_QUOTING_MISMATCH", f"declared {config.quoted}, detected {dialect['quoted']}"))
    if any(r.endings.mixed for r in report):
        notes.append(("W_LINE_ENDING", "mixed line endings"))
    with failing("E_CSV_PARSE_FAILED"):
        fatal = found.where("code = 'E_JAGGED_ROW'").orderBy("line").first()
    if fatal is not None:
        raise RunFailed("E_JAGGED_ROW", f"row {fatal.line}: {fatal.message}")
    if notes:
        found = found.union(spark.createDataFrame([(c, m, None) for c, m in notes], "code string, message string, line long"))
    with failing("E_PIPELINE_FAILED"):
        out = profile_table(table, config, found, dialect | {"files": [{"path": r.path, "sha256": r.sha256, "n_bytes": r.n_bytes, "bom": r.bom, "line_ending": r.endings.style, "crlf": r.endings.crlf > 0} for r in report], "at": time.time()})
    progress(100, "done")
    return out
