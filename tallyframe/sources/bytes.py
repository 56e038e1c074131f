"""Checks on whole files: UTF-8, line endings, hashes."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import BOM, DAMAGED, GZIP, streamed, unpacked


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content, error_code): a row a file, gzip (by its mark, not its name) unpacked."""
    def run(batches):
        for frame in batches:
            out = []
            for raw in frame["content"]:
                raw = bytes(raw)
                try:
                    out.append((gzip.decompress(raw), None) if raw[:2] == GZIP else (raw, None))
                except DAMAGED:
                    out.append((None, "E_GZIP_DECOMPRESS"))
            yield pd.DataFrame({"path": frame["path"], "content": [x for x, _ in out], "error_code": [x for _, x in out]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content binary, error_code string")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, path): the lines of all files. Plain files and those named .gz are split and read in the
    JVM; gzip files of other names are found by their mark (a row a file comes to the driver) and
    unpacked piece by piece, in a task each. Line ends are LF, CRLF and CR."""
    plain = lambda where: spark.read.text(where).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    marked = [r.path for r in plain(path).where((F.col("at") == 0) & (F.substring(F.col("value").cast("binary"), 1, 2) == F.lit(GZIP))).select("path").distinct().collect()]
    if not marked:
        return plain(path).select("value", "path")

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                held = b""
                for piece in unpacked(raw.as_buffer().to_pybytes()):
                    held += piece
                    # a carriage return at the very end may be half of a line end
                    *whole, held = re.split(rb"\r\n|\n|\r(?=[^\n])", held)
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array([path] * len(whole), pa.string())], ["value", "path"])
                if held := held.removesuffix(b"\r"):
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([path], pa.string())], ["value", "path"])

    packed = spark.read.format("binaryFile").load(marked).select(F.col("path"), "content").mapInArrow(run, "value binary, path string")
    rest = plain(path).where(~F.col("path").isin(marked)).select("value", "path")
    return rest.union(packed.select(F.col("value").cast("string"), "path"))


@F.pandas_udf(T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("offset", T.LongType()), T.StructField("reason", T.StringType())]))
def utf8_check(content: pd.Series) -> pd.DataFrame:
    """Whether bytes are UTF-8; else where the first bad one stands, counted from 0, and why."""
    rows = []
    for raw in content:
        try:
            bytes(raw or b"").decode("utf-8")
            rows.append((True, None, None))
        except UnicodeDecodeError as bad:
            rows.append((False, bad.start, bad.reason))
    return pd.DataFrame(rows, columns=["is_valid", "offset", "reason"])


def utf8(content: Column) -> Column:
    """utf8_check, with only the bytes that are not UTF-8 sent to Python."""
    return utf8_check(F.when(~F.is_valid_utf8(content.cast("string")), content))


def has_bom(content: Column) -> Column:
    return F.substring(content, 1, 3) == F.lit(BOM)


def ends_struct(crlf: Column, lf: Column, cr: Column) -> Column:
    most = F.greatest(crlf, lf, cr)
    style = F.when(most == 0, "NONE").when(crlf == most, "CRLF").when(lf == most, "LF").otherwise("CR")
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.struct(crlf.alias("crlf"), lf.alias("lf"), cr.alias("cr"), style.alias("style"), (kinds >= 2).alias("mixed"))


def line_endings(text: Column) -> Column:
    """A struct of crlf, lf, cr, style and mixed; the majority's style, ties to CRLF, LF, CR; else NONE."""
    crlf, lf, cr = (F.regexp_count(text, F.lit(p)).cast("long") for p in (r"\r\n", r"(?<!\r)\n", r"\r(?!\n)"))
    return ends_struct(crlf, lf, cr)


def outside_quotes(text: Column) -> Column:
    """The text without its quoted parts, for a census that minds quotes."""
    return F.regexp_replace(text, r'"(?:[^"]|"")*"', "")


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


class LineEnds:
    """A count of line ends that goes on from piece to piece."""

    def __init__(self, counts: tuple[int, int, int] = (0, 0, 0), held: bytes = b""):
        self.counts, self.held = counts, held

    def add(self, piece: bytes, last: bool = False) -> None:
        piece = self.held + piece
        self.held = b"" if last or not piece.endswith(b"\r") else b"\r"
        piece = piece.removesuffix(self.held)
        both = piece.count(b"\r\n")
        found = both, piece.count(b"\n") - both, piece.count(b"\r") - both
        self.counts = tuple(map(sum, zip(self.counts, found)))

    def copy(self) -> LineEnds:
        return LineEnds(self.counts, self.held)


class LineEndsOutsideQuotes:
    """The same without quoted parts; a quote that never closes quotes nothing."""

    def __init__(self):
        self.outside, self.open = LineEnds(), None

    def add(self, piece: bytes) -> None:
        for k, part in enumerate(piece.split(b'"')):
            if k and self.open is None:
                self.open = self.outside.copy()
                self.open.add(b'"')
            elif k:
                self.open = None
            (self.outside if self.open is None else self.open).add(part)

    def end(self) -> tuple[int, int, int]:
        left = self.open or self.outside
        left.add(b"", True)
        return left.counts


def first_fault(pieces: Iterator[bytes], seen) -> tuple[bool, int | None, str | None]:
    """Whether the pieces are UTF-8 together, else the offset and reason of the first fault; ``seen``
    gets every piece, also those after a fault."""
    held, at, fault = b"", 0, None
    for piece in pieces:
        seen(piece)
        if fault is None:
            data, held = held + piece, b""
            try:
                data.decode("utf-8")
            except UnicodeDecodeError as bad:
                if bad.end == len(data) and bad.reason == "unexpected end of data":
                    held = data[bad.start:]  # the next piece may complete it
                else:
                    fault = at + bad.start, bad.reason
            at += len(data) - len(held)
    if fault is None and held:
        fault = at, "unexpected end of data"
    return (True, None, None) if fault is None else (False, *fault)


def file_report(spark: SparkSession, path: str, quote_aware: bool = False, census_bytes: int | None = None, **settings) -> DataFrame:
    """A row a file: path, size, sha256, BOM, UTF-8 verdict and line endings (of the first
    ``census_bytes``, if given). A file is read once, a piece at a time; one that is packed and damaged
    has an error code and nothing else. ``settings``: those of ``streamed``."""
    def run(name, pieces):
        digest, size, start = hashlib.sha256(), 0, b""
        ends = LineEndsOutsideQuotes() if quote_aware else LineEnds()

        def seen(piece):
            nonlocal size, start
            start = start or piece[:3]
            start = (start + piece)[:3] if len(start) < 3 and size else start
            digest.update(piece)
            ends.add(piece if census_bytes is None else piece[:max(0, census_bytes - size)])
            size += len(piece)

        try:
            verdict = first_fault(pieces, seen)
        except DAMAGED:
            row = (name, *[None] * 9, "E_GZIP_DECOMPRESS")
        else:
            if not quote_aware:
                ends.add(b"", True)
            row = (name, size, digest.hexdigest(), start == BOM, *verdict, *(ends.end() if quote_aware else ends.counts), None)
        yield pa.RecordBatch.from_pylist([dict(zip(fields, row))], schema=arrow)

    fields = ["path", "n_bytes", "sha256", "bom", "is_valid", "offset", "reason", "crlf", "lf", "cr", "error_code"]
    arrow = pa.schema(list(zip(fields, [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])))
    rows = streamed(spark, path, run, "path string, n_bytes long, sha256 string, bom boolean, is_valid boolean, offset long, reason string, crlf long, lf long, cr long, error_code string", **settings)
    return rows.select(*fields[:7], F.when(F.col("crlf").isNotNull(), ends_struct(F.col("crlf"), F.col("lf"), F.col("cr"))).alias("endings"), "error_code")
