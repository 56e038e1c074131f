"""Error codes, their messages, and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes with their default messages, those that end a run, and friendlier words.
MESSAGES = {
    "E_UTF8_INVALID": "Invalid UTF-8 byte sequence detected",
    "E_HEADER_MISSING": "Header row not found or file is empty",
    "E_HEADER_INVALID": "Header row could not be read",
    "E_JAGGED_ROW": "Inconsistent column count detected",
    "E_QUOTE_RULE": "Quote escaping violation detected",
    "E_UNQUOTED_DELIM": "Unquoted embedded delimiter detected",
    "E_NUMERIC_FORMAT": "Invalid numeric format detected",
    "E_MONEY_FORMAT": "Invalid money format detected",
    "E_MIXED_FORMAT": "Conflicting value formats detected",
    "E_DATE_MIXED_FORMAT": "Inconsistent date formats in column",
    "W_DATE_FORMAT": "More than one date format in column",
    "W_DATE_RANGE": "Date outside expected range",
    "W_LINE_ENDING": "Mixed line endings detected",
    "W_DELIMITER_MISMATCH": "Detected delimiter differs from the declared one",
    "W_QUOTING_MISMATCH": "Detected quoting differs from the declared one",
    "E_GZIP_DECOMPRESS": "The gzip data could not be read",
    "E_CSV_PARSE_FAILED": "The file could not be parsed",
    "E_TYPE_INFERENCE_FAILED": "Types could not be inferred",
    "E_PIPELINE_FAILED": "The run failed",
    "E_PROCESSING_FAILED": "Processing failed",
    "E_UPLOAD_FAILED": "The file could not be received",
    "E_INTERNAL_ERROR": "Internal error",
}
FATAL = {"E_UTF8_INVALID", "E_HEADER_MISSING", "E_HEADER_INVALID", "E_JAGGED_ROW", "E_GZIP_DECOMPRESS", "E_CSV_PARSE_FAILED", "E_TYPE_INFERENCE_FAILED", "E_PIPELINE_FAILED", "E_PROCESSING_FAILED", "E_UPLOAD_FAILED", "E_INTERNAL_ERROR"}
FRIENDLY = {
    "E_UTF8_INVALID": "The file has bytes that are not UTF-8 text. Save it as UTF-8 and try again.",
    "E_HEADER_MISSING": "The file needs a header row with column names.",
    "E_JAGGED_ROW": "Some rows have more or fewer fields than the header.",
    "E_QUOTE_RULE": "Some quoted fields are not closed or escaped as they should be.",
    "E_UNQUOTED_DELIM": "Some fields hold the delimiter without quotes around them.",
}


def friendly(code: str, message: str = "") -> str:
    """Words for a user, then the technical message where there is one; other codes have only that."""
    if code not in FRIENDLY:
        return message or MESSAGES.get(code, code)
    return f"{FRIENDLY[code]} ({message})" if message else FRIENDLY[code]


def rollup(errors: DataFrame, total_rows: int | None = None) -> DataFrame:
    """(code, message, count, percentage, is_catastrophic, is_warning, first_line, column), most frequent first.

    ``errors`` has code and, where known, message, count, line and column; equal codes add up.
    """
    for name, kind in (("message", "string"), ("count", "long"), ("line", "long"), ("column", "string")):
        if name not in errors.columns:
            errors = errors.withColumn(name, F.lit(1 if name == "count" else None).cast(kind))
    known = F.create_map(*(F.lit(x) for item in MESSAGES.items() for x in item))
    out = errors.groupBy("code").agg(F.sum("count").alias("count"), F.min_by("message", F.coalesce("line", F.lit(1 << 62))).alias("message"), F.min("line").alias("first_line"), F.min_by("column", F.coalesce("line", F.lit(1 << 62))).alias("column"))
    share = F.lit(None).cast("double") if not total_rows else 100.0 * F.col("count") / total_rows
    return out.select("code", F.coalesce("message", known[F.col("code")], "code").alias("message"), "count", share.alias("percentage"), F.col("code").isin(*FATAL).alias("is_catastrophic"), F.col("code").startswith("W_").alias("is_warning"), "first_line", "column").orderBy(F.desc("count"), "code")


def sampled(errors: DataFrame, n: int = 10) -> DataFrame:
    """At most n errors of each code, the earliest lines; counts stay with rollup()."""
    from pyspark.sql import Window

    salted = errors.withColumn("__salt", F.pmod(F.xxhash64("line"), F.lit(64)))
    near = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("code", "__salt").orderBy("line"))).where(F.col("__rank") <= n)
    return near.withColumn("__rank", F.row_number().over(Window.partitionBy("code").orderBy("line"))).where(F.col("__rank") <= n).drop("__salt", "__rank")
