"""Delimited text to rows of strings with error codes.

Unquoted files split by lines inside the JVM and at any size. Quoted fields may hold line ends, so a
quoted file is parsed as one stream of pieces, in one task for each file and at any size; files that are
known to be clean can take Spark's own reader instead.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytes import files, lines, to_lf
from .dialect import SAMPLE_BYTES, detect_delimiter, detect_quoting, head
from .pieces import DAMAGED, streamed

ROWS = "_row_id long, fields array<string>, error_code string, message string"


class HeaderMissing(ValueError):
    code = "E_HEADER_MISSING"


def read_header(sample: bytes, delimiter: str, quoted: bool, has_header: bool = True) -> list[str]:
    """Column names as they stand, without a byte order mark; an empty file or header raises."""
    text = sample.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    first = next(csv.reader(io.StringIO(text), delimiter=delimiter, quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE), [])
    if not has_header or not any(x.strip() for x in first):
        raise HeaderMissing("a header row is needed")
    return first


def fit_row(fields: list[str], width: int, quoted: bool) -> tuple[list[str], str | None]:
    """Empty fields beyond the header go; one more field hints at an unquoted delimiter."""
    fields = list(fields)
    while len(fields) > width and fields[-1] == "":
        fields.pop()
    if len(fields) == width:
        return fields, None
    return fields, "E_UNQUOTED_DELIM" if quoted and len(fields) == width + 1 else "E_JAGGED_ROW"


def text_lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """The lines of a file's pieces with their line feeds, without a byte order mark; LF, CRLF and CR
    end a line, bytes that are not UTF-8 are replaced."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), translate=True)
    held: list[str] = []
    begun = False

    def decoded():
        for piece in pieces:
            yield decoder.decode(piece)
        yield decoder.decode(b"", final=True)

    for text in decoded():
        if text and not begun:
            text, begun = text.removeprefix("\ufeff"), True
        first, *rest = text.split("\n")
        held.append(first)
        for line in rest:
            yield "".join([*held, "\n"])
            held = [line]
    if last := "".join(held):
        yield last


def parse_quoted(lines: Iterable[str], delimiter: str, width: int):
    """(number, fields, code, message) of each data row; blank lines have the code BLANK."""
    reader = csv.reader(lines, delimiter=delimiter, strict=True)
    number = 0
    try:
        next(reader, None)
    except csv.Error:
        pass
    while True:
        number += 1
        try:
            fields = next(reader)
        except StopIteration:
            return
        except csv.Error as bad:
            yield number, None, "E_QUOTE_RULE", str(bad)
            continue
        if not fields:
            yield number, [], "BLANK", None
            continue
        fields, code = fit_row(fields, width, True)
        yield number, fields, code, f"expected {width} fields, found {len(fields)}" if code else None


def parsed_rows(spark: SparkSession, path: str, delimiter: str, quoted: bool, width: int, **settings) -> DataFrame:
    """Every data row with its 1-based number, fields and error code.

    Every file of a folder has a header of its own; rows are numbered on over all files. ``settings``:
    those of ``streamed``, which reads quoted files.
    """
    if quoted:
        def run(name, pieces):
            rows, damaged = parse_quoted(text_lines(pieces), delimiter, width), False
            number = 0
            while not damaged:
                part = []
                try:
                    for row in itertools.islice(rows, 10_000):
                        part.append(row)
                except DAMAGED as bad:  # packed bytes that end early: what came before stands
                    part.append(((part[-1][0] if part else number) + 1, None, "E_GZIP_DECOMPRESS", str(bad)))
                    damaged = True
                if not part:
                    return
                number = part[-1][0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *(pa.array(x, kind) for x, kind in zip(zip(*part), kinds))], ["path", "_row_id", "fields", "error_code", "message"])

        kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        rows = streamed(spark, path, run, f"path string, {ROWS}", **settings)
        sizes = rows.groupBy("path").agg(F.max("_row_id").alias("n"))  # a row a file
        before = sizes.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
        return rows.join(F.broadcast(before), "path").select((F.col("_row_id") + F.col("before")).alias("_row_id"), "fields", "error_code", "message")
    rows = numbered(lines(spark, path))
    fields = F.split("value", f"\\Q{delimiter}\\E", -1)
    extra = F.slice(fields, F.lit(width + 1), F.greatest(F.lit(0), F.size(fields) - width))
    fitted = F.when((F.size(fields) > width) & ~F.exists(extra, lambda x: x != ""), F.slice(fields, 1, width)).otherwise(fields)
    code = F.when(F.col("value") == "", "BLANK").when(F.size("fields") != width, "E_JAGGED_ROW")
    message = F.when(F.col("error_code") == "E_JAGGED_ROW", F.concat(F.lit(f"expected {width} fields, found "), F.size("fields").cast("string")))
    return rows.withColumn("fields", fitted).withColumn("error_code", code).select(F.col("line").alias("_row_id"), "fields", "error_code", message.alias("message"))


def numbered(found: DataFrame) -> DataFrame:
    """Lines but the first of each path, numbered from 1 in reading order.

    Partitions are counted first (a row for each partition and file); what stands before a partition is
    added to the place within it, and the headers up to there are taken off.
    """
    part = F.shiftright(F.col("id"), 33)
    rows = found.withColumn("id", F.monotonically_increasing_id()).withColumn("part", part)
    sizes = rows.groupBy("part", "path").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sizes = sizes.withColumn("header", F.col("first") == F.min("first").over(Window.partitionBy("path")))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("header"), F.col("first"))).alias("headers"))
    data = F.col("n") - F.size("headers")
    parts = parts.select("part", "headers", (F.sum(data).over(Window.orderBy("part")) - data).alias("before"))
    rows = rows.join(F.broadcast(parts), "part").where(~F.array_contains("headers", F.col("id")))
    above = F.size(F.filter("headers", lambda h: h < F.col("id")))
    return rows.select("value", (F.col("before") + F.col("id") - F.shiftleft(part, 33) - above + 1).alias("line"))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, quoted: bool | None = None, has_header: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(table, errors, dialect). The table has a string column for each name and _row_id; rows with an
    error code are in ``errors`` (code, message, line) instead; blank lines in neither."""
    sample = head(spark, path)
    found, sure = detect_delimiter(sample)
    # what is declared only counts where nothing is detected
    mark = delimiter if delimiter and sure <= 0.5 else found
    quoting, sure_quoted = detect_quoting(sample, mark)
    quoting = quoted if quoted is not None and sure_quoted <= 0.5 else quoting
    names = read_header(sample if b"\n" in sample or len(sample) < SAMPLE_BYTES else head(spark, path, 1 << 20), mark, quoting, has_header)
    rows = parsed_rows(spark, path, mark, quoting, len(names))
    table = rows.where("error_code is null").select("_row_id", *(F.col("fields")[i].alias(name) for name, i in {name: i for i, name in enumerate(names)}.items()))  # of equal names the last counts
    errors = rows.where("error_code is not null and error_code != 'BLANK'").select(F.col("error_code").alias("code"), "message", F.col("_row_id").alias("line"))
    return table, errors, {"delimiter": found, "delimiter_confidence": sure, "quoted": detect_quoting(sample, found)[0], "quoted_confidence": sure_quoted, "used_delimiter": mark, "used_quoting": quoting, "columns": names}


def read_clean(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Spark's own reader, all strings: for files without errors, split and read in parallel."""
    return spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', inferSchema=False)


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code").agg(F.count("*").alias("count"))


def normalised_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) with line feeds only."""
    return files(spark, path).select("path", to_lf(F.decode("content", "UTF-8")).alias("text"))
