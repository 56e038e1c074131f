"""Files as ordered pieces of bounded size: one task a file, at any length.

Small files and packed ones come whole from ``binaryFile`` and are cut in the worker. Large plain files
are read by lines, split over tasks; lines are packed into pieces there, and the pieces of a file meet in
order in one task, which holds a piece at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"
BOM = b"\xef\xbb\xbf"
#: Files up to WHOLE bytes are read whole; a piece has about PIECE bytes, or one line.
WHOLE, PIECE = 64 << 20, 1 << 20
#: What packed bytes that are damaged raise.
DAMAGED = (OSError, EOFError, zlib.error)


def unpacked(raw, size: int = PIECE) -> Iterator[bytes]:
    """The contents of gzip members one after another, in pieces of about ``size`` bytes; a member that
    ends early raises EOFError."""
    raw, machine, begun = memoryview(raw), zlib.decompressobj(31), False
    at, rest = 0, b""
    while rest or at < len(raw):
        if not rest:
            rest, at = bytes(raw[at:at + PIECE]), at + PIECE
        if not begun and not (rest := rest.lstrip(b"\0")):
            continue  # members may be padded
        begun = True
        piece = machine.decompress(rest, size)
        rest = machine.unconsumed_tail
        while piece:
            yield piece
            piece = machine.decompress(rest, size) if rest and not machine.eof else b""
            rest = machine.unconsumed_tail
        if machine.eof:
            rest, machine, begun = machine.unused_data, zlib.decompressobj(31), False
    if begun:
        if last := machine.flush():
            yield last
        if not machine.eof:
            raise EOFError("the packed data ends early")


def cut(raw, size: int = PIECE) -> Iterator[bytes]:
    raw = memoryview(raw)
    for at in range(0, len(raw), size):
        yield bytes(raw[at:at + size])


def _packed_lines(size: int):
    """Lines in order to pieces (path, block, at, piece) with a line feed after each line."""
    def run(batches):
        for batch in batches:
            held: list[bytes] = []
            start, total = None, 0

            def piece():
                return pa.RecordBatch.from_arrays([pa.array([start[0]]), pa.array([start[1]], pa.int64()), pa.array([start[2]], pa.int64()), pa.array([b"\n".join([*held, b""])], pa.binary())], ["path", "block", "at", "piece"])  # noqa: B023

            for path, block, at, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "at", "value"))):
                if held and (total > size or start[:2] != (path, block)):
                    yield piece()
                    held, total = [], 0
                if not held:
                    start = (path, block, at)
                held.append(value)
                total += len(value) + 1
            if held:
                yield piece()

    return run


def streamed(spark: SparkSession, path: str | list[str], run: Callable, schema: str, whole: int | None = None, size: int = PIECE) -> DataFrame:
    """What ``run(path, pieces)`` yields (record batches of ``schema``) for each file.

    ``pieces`` are the bytes of a file in order, unpacked if its mark says gzip. The driver reads the
    paths of packed files above ``whole``; such files, packed, end at the 2 GB of ``binaryFile``.
    """
    whole = WHOLE if whole is None else whole
    found = spark.read.format("binaryFile").load(path)

    def of_whole(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = raw.as_buffer()
                yield from run(name, unpacked(raw, size) if bytes(raw[:2]) == GZIP else cut(raw, size))

    small = found.where(F.col("length") <= whole).select("path", "content").mapInArrow(of_whole, schema)
    large = [r.path for r in found.where(F.col("length") > whole).select("path").collect()]  # a row a large file
    if not large:
        return small

    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(name, "^file:/+", "file:/")
    text = spark.read.option("lineSep", "\n").text(large).select(F.col("value").cast("binary").alias("value"), name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    n = F.sum(F.octet_length("value") + 1)
    facts = text.groupBy("path").agg(n.alias("n"), F.max("bytes").alias("bytes"), F.min_by(F.substring("value", 1, 2), F.struct("block", "at")).alias("mark"))
    packed = [r.path for r in facts.where(F.col("mark") == F.lit(GZIP)).select("path").collect()]
    if packed:
        small = small.union(found.where(F.col("path").isin(packed)).select("path", "content").mapInArrow(of_whole, schema))
    # the reader takes off a mark of byte order and does not say whether the last line ends
    facts = facts.where(~F.col("path").isin(packed)).select("path", (F.col("bytes") - F.col("n")).alias("short"))

    def of_pieces(batches):
        def one(path):
            nonlocal row
            first, short = True, row[1]
            held = b""
            while row is not None and row[0] == path:
                if held:
                    yield held
                held = BOM + row[2] if first and short >= 2 else row[2]
                first = False
                row = next(rows, None)
            # one line feed too many where the last line has none: short is -1, or 2 after a mark
            yield held[:-1] if short in (-1, 2) else held

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "short", "piece"))))
        row = next(rows, None)
        while row is not None:
            path = row[0]
            pieces = one(path)
            yield from run(path, pieces)
            for _ in pieces:  # what run did not ask for
                pass

    pieces = text.select("value", "path", "block", "at").mapInArrow(_packed_lines(size), "path string, block long, at long, piece binary").join(facts, "path")
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "block", "at").select("path", "short", "piece")
    return small.union(pieces.mapInArrow(of_pieces, schema))
