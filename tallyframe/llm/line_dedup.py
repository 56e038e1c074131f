"""Line dedup within one edit: a join of hashed deletion variants, verified, keeping the earliest.

Two lines are at most one edit apart if they are equal, if deleting one character of one gives the
other, or if deleting the same place from both gives the same. Variants are emitted only for lines that
can have a partner: an edit lies in one of SEGMENTS parts, so a pair agrees on all but that part, and
lines that agree with no other line on such a frame are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, UNBASE, buffers, each_text, mix, partitions, powers, released, small_batches, stage, steps

SEGMENTS = 4
#: Lines whose frames a task holds before it deals them out.
HELD_LINES = 1 << 16
FRAME = np.dtype([("frame", "u8"), ("h1", "i8"), ("h2", "i8")])


@lru_cache(4)
def _table(salt: int) -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(salt))


def _mixed(chars: np.ndarray, salt: int) -> np.ndarray:
    """Each character mixed with the salt: looked up, but for those past the table."""
    out = _table(salt)[np.minimum(chars, np.uint32(0xFFFF))]
    far = np.flatnonzero(chars > 0xFFFF)
    if len(far):
        out[far] = mix(chars[far].astype(np.uint64) + np.uint64(salt))
    return out


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[:-1], out=out[1:])
    return out


def char_lines(array):
    """For runs of rows: (sums, start, stop, row, number, h1, h2) of the lines that are not blank.

    sums: running hash of the characters, from which a part of any line is hashed; h1 and h2 name the
    whole line.
    """
    offsets, data = buffers(array)
    view = memoryview(data)
    for i, j in steps(offsets):
        texts = [bytes(view[offsets[k]:offsets[k + 1]]).decode("utf-8", "replace") for k in range(i, j)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        chars = np.frombuffer("".join([x + "\n" for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.flatnonzero(chars == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        ends = np.cumsum(sizes)
        row = np.searchsorted(ends, start, "right")
        opens = np.flatnonzero(np.diff(row, prepend=-1))
        number = np.arange(len(start)) - np.repeat(opens, np.diff(np.append(opens, len(start))))
        seen = np.zeros(len(chars) + 1, np.int64)  # blanks are space and 9 to 13; a line holds no 10
        np.cumsum((chars != 32) & (chars - np.uint32(9) > 4), out=seen[1:])
        full = seen[stop] > seen[start]
        start, stop, row, number = start[full], stop[full], row[full], number[full]
        sums, back = _running(_mixed(chars, 1)), powers(UNBASE, len(chars))
        again = _running(_mixed(chars, 1 << 40))
        size = (stop - start).astype(np.uint64)
        h1, h2 = (mix((x[stop] - x[start]) * back[start] + size).view(np.int64) for x in (sums, again))
        yield sums, start, stop, row + i, number, h1, h2


def _split(batches):
    """A row for each line."""
    for batch in batches:
        rows, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
        for _, _, _, row, number, h1, h2 in char_lines(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[row], ids[row], number, h1, h2)], ["row", "id", "line", "h1", "h2"])


def _characters(line: bytes) -> np.ndarray:
    return np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _frames(sums: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """For each line's length and for one less: the line without each of its parts, hashed."""
    power, back = powers(BASE, len(sums)), powers(UNBASE, len(sums))
    for size in (stop - start, stop - start - 1):
        for part in range(SEGMENTS):
            head, tail = part * size // SEGMENTS, size - (part + 1) * size // SEGMENTS
            front = (sums[start + head] - sums[start]) * back[start]
            rest = (sums[stop] - sums[stop - tail]) * back[stop - tail]
            yield mix(front + rest * power[head] + mix((size.astype(np.uint64) << np.uint64(8)) + np.uint64(part)))


def _framed(buckets: int):
    def dealt(made):
        h1, h2, frames = (np.concatenate(x) for x in zip(*made))
        _, at = np.unique(h1, return_index=True)  # equal names go once
        rows = np.empty((len(at), 2 * SEGMENTS), FRAME)
        rows["frame"], rows["h1"], rows["h2"] = frames[at], h1[at, None], h2[at, None]
        rows = rows.ravel()
        where = (rows["frame"] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(where.astype(np.uint16) if buckets <= 1 << 16 else where, kind="stable")
        rows, where = rows[order], where[order]
        first = np.flatnonzero(np.diff(where, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(where[first], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, first[1:])], pa.binary())], ["bucket", "rows"])

    def run(batches):
        made, held = [], 0
        for batch in batches:
            for sums, start, stop, _, _, h1, h2 in char_lines(batch.column("text")):
                _, at = np.unique(h1, return_index=True)
                if not len(at):
                    continue
                made.append((h1[at], h2[at], np.stack(list(_frames(sums, start[at], stop[at])), axis=1)))
                held += len(at)
                if held >= HELD_LINES:
                    yield dealt(made)
                    made, held = [], 0
        if made:
            yield dealt(made)

    return run


def _partnered(batches):
    """The lines of each bucket that share a frame with a different line."""
    def judge(rows):
        rows = rows[np.lexsort((rows["h2"], rows["h1"], rows["frame"]))]
        new = np.ones(len(rows), bool)
        new[1:] = rows["frame"][1:] != rows["frame"][:-1]
        other = np.zeros(len(rows), bool)
        other[1:] = ~new[1:] & ((rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))
        first = np.flatnonzero(new)
        mixed = np.add.reduceat(other.astype(np.int64), first) > 0
        some = np.unique(rows[np.repeat(mixed, np.diff(np.append(first, len(rows))))][["h1", "h2"]])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some["h1"]), pa.array(some["h2"])], ["h1", "h2"])

    held, now = [], None
    for batch in batches:
        for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
            if bucket != now and held:
                yield from judge(np.concatenate(held))
                held = []
            now = bucket
            held.append(np.frombuffer(rows.as_buffer(), FRAME))
    if held:
        yield from judge(np.concatenate(held))


def _fetch(batches):
    """The named lines of each document, with their texts."""
    for batch in batches:
        named = {}
        for _, _, _, row, number, h1, h2 in char_lines(batch.column("text")):
            named.update(zip(zip(row.tolist(), number.tolist()), zip(h1.tolist(), h2.tolist())))
        out: list[list] = [[], [], [], [], []]
        for k, (id_, wanted, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("lines").to_pylist(), each_text(batch.column("text")))):
            lines = text.decode("utf-8", "replace").split("\n")
            for x in wanted:
                if named.get((k, x["line"])) == (x["h1"], x["h2"]):
                    for column, value in zip(out, (x["h1"], x["h2"], id_, x["line"], lines[x["line"]])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())], ["h1", "h2", "id", "line", "body"])


def _variants(batches):
    """(variant, place, whole) of each line: itself (place -1), and each deletion by place and without."""
    for batch in batches:
        for k in range(batch.num_rows):
            chars = _characters(batch.column("body")[k].as_py().encode())
            n, sums = len(chars), _running(_mixed(chars, 1))
            at = np.arange(n)
            deleted = sums[:n] + (sums[n] - sums[at + 1]) * np.uint64(UNBASE)
            keys = mix(np.concatenate([sums[n:] , deleted]) + mix(np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64)))
            places = np.concatenate([[-1], at])
            size = n + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places, pa.int32()), *(pa.array(np.full(size, batch.column(c)[k].as_py()), pa.int64()) for c in ("h1", "h2", "id", "line"))], ["variant", "place", "h1", "h2", "id", "line"])


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _true_pairs(batches):
    for batch in batches:
        good = [within_one_edit(a, b) for a, b in zip(batch.column("body").to_pylist(), batch.column("other").to_pylist())]
        yield batch.select(["h1", "h2"]).filter(pa.array(good, pa.bool_()))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_lines, n_exact, n_near, dropped (line numbers from 0).

    Lines end at line feeds. A line of any length goes if an equal line or one within one edit stands
    earlier, itself dropped or not; earlier means a smaller id, then line number; a null id comes last.
    Blank lines stay and are not counted. A null text has no lines. Rows
    that repeat an id and a text keep one copy of each line. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    top = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(top)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    lines = stage(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(released(_split), "row long, id long, line long, h1 long, h2 long"), "lines")
    firsts = stage(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "row")).alias("first")), "firsts")
    paired = rows.select("text").mapInArrow(released(_framed(4 * n)), "bucket int, rows binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_partnered), "h1 long, h2 long").distinct()
    wanted = firsts.join(paired, ["h1", "h2"]).groupBy("first.id").agg(F.collect_list(F.struct("h1", "h2", F.col("first.line").alias("line"))).alias("lines"))
    bodies = stage(rows.join(wanted.hint("shuffle_hash"), "id").select("id", "text", "lines").mapInArrow(released(_fetch), "h1 long, h2 long, id long, line long, body string").dropDuplicates(["h1", "h2"]), "bodies")
    made = stage(bodies.mapInArrow(released(_variants), "variant long, place int, h1 long, h2 long, id long, line long"), "variants")
    who = F.struct("id", "line", "h1", "h2")
    # the same place deleted: all are one substitution apart, so the earliest answers for each
    swapped = made.where("place >= 0").groupBy("variant", "place").agg(F.min(who).alias("early"), F.count("*").alias("n")).where("n > 1")
    # a line that is another's deletion: the whole one is one line at most, so a star again
    whole = made.where("place < 0").select("variant", who.alias("whole"))
    less = made.where("place >= 0").select("variant", who.alias("longer")).join(whole, "variant")
    pair = lambda df, late, early: df.select(F.col(f"{late}.h1").alias("h1"), F.col(f"{late}.h2").alias("h2"), F.col(f"{early}.h1").alias("e1"), F.col(f"{early}.h2").alias("e2"))
    shorter = less.groupBy("variant").agg(F.min("whole").alias("late"), F.min("longer").alias("early")).where("early < late")
    pairs = pair(less.where("whole < longer"), "longer", "whole").union(pair(shorter, "late", "early"))
    pairs = pairs.union(pair(made.where("place >= 0").select("variant", "place", who.alias("late")).join(swapped, ["variant", "place"]).where("early < late"), "late", "early")).distinct()
    texts = bodies.select("h1", "h2", "body")
    proven = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("body").alias("other")), ["e1", "e2"])
    near = proven.select("h1", "h2", "body", "other").mapInArrow(released(_true_pairs), "h1 long, h2 long").distinct().withColumn("near", F.lit(True))
    fate = firsts.join(near, ["h1", "h2"], "left")
    judged = lines.join(fate, ["h1", "h2"]).withColumn("exact", F.struct("id", "line", "row") != F.col("first"))
    drop = F.col("exact") | F.coalesce("near", F.lit(False))
    out = judged.groupBy("row").agg(F.min("id").alias("id"), F.count("*").alias("n_lines"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum((~F.col("exact") & drop).cast("long")).alias("n_near"), F.sort_array(F.collect_list(F.when(drop, F.col("line")))).alias("dropped"))
    bare = rows.select("id", "text").where(~F.col("text").rlike(r"[^ \t\n\x0b\f\r]")).select("id", *(F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_exact", "n_near")), F.array().cast("array<bigint>").alias("dropped"))
    return out.drop("row").union(bare).withColumn("id", F.when(F.col("id") != top, F.col("id")))


def op2(spark, sf_dir: str) -> DataFrame:
    return duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
