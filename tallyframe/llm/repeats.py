"""Repeated strings across a corpus: blockwise sorting of suffixes over a cover sample.

A full suffix array of the corpus would shuffle a row for every byte. Here a cover sample carries it:
every window of ``cover`` positions holds a sampled one (the least hashed gram), and equal strings
sample equal offsets, which is what a difference cover gives, at a sixth of its density. Suffixes
that start between two samples differ only in their head; what follows is named by the sample.

1. Each sample names the ``length - cover + 1`` symbols from it (every window of its stretch holds them)
   and the whole stretch: all windows that have this sample. Names are dealt to suffix buckets, and one
   bucket is sorted at a time. A stretch found twice is repeated whole. Where one name has different
   stretches, the ties are long: those that stand for each different stretch go on.
2. The windows of those stretches are named (the head joined to what the sample named) and sorted, again
   one bucket at a time; a window found twice is repeated.
3. Spans meet their texts again, and what remains is hashed.

Symbols are bytes for what is removed, and words for passages that documents share; both travel through
the same steps and shuffles.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_2, BLANK, BYTE_VALUES, BYTE_VALUES_2, UNBASE, UNBASE_2, buffers, mix, names_of, partitions, powers, prefix_sums, stage, steps, word_edges

COVER, GRAM = 128, 16
WORD_COVER, WORD_GRAM = 32, 3
#: A longer text is worked on in stretches of this many bytes.
PIECE = 4 << 20
#: Rows that need no judging travel in parts of so many.
PART = 1 << 14
#: name: of the sample (a window: of it all) by the first polynomial; full: of all by the second.
ENTRY = np.dtype([("name", "u8"), ("full", "u8"), ("id", "i8"), ("tag", "i8"), ("lo", "i4"), ("end", "i4")])
WINDOW = np.dtype([("name", "u8"), ("full", "u8"), ("id", "i8"), ("tag", "i8"), ("lo", "i4")])
ROWS = "unit int, bucket int, rows binary"
SPANS = "id long, tag long, unit int, open boolean, lo int, end int"


class Unit(NamedTuple):
    """What is compared. apart: only what another document holds too counts as repeated."""

    number: int
    length: int
    cover: int
    gram: int
    apart: bool


def units_of(length: int, passage_words: int) -> tuple[Unit, Unit]:
    for size, least in ((length, 2 * COVER), (passage_words, WORD_COVER + WORD_GRAM)):
        if size < least:
            raise ValueError(f"a length of {size} is under the least one, {least}")
    return Unit(0, length, COVER, GRAM, False), Unit(1, passage_words, WORD_COVER, WORD_GRAM, True)


def _byte_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prefix_sums(BYTE_VALUES[text]), prefix_sums(BYTE_VALUES_2[text], BASE_2)


def stretches(one: np.ndarray, two: np.ndarray, stops: np.ndarray, unit: Unit):
    """(lo, end, name, full) of all stretches: window starts lo .. end - length have one sample.

    one, two: prefix sums of the symbols; stops: for each symbol where its document ends; no window
    crosses.
    """
    n = len(one) - 1
    if n < unit.length:
        return None
    m = n - unit.gram + 1
    key = mix((one[unit.gram:] - one[:m]) * powers(UNBASE, n)[:m]) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(m, dtype=np.uint64)
    step = 1
    while step < unit.cover:
        low = key.copy()
        np.minimum(key[:-step], key[step:], out=low[:-step])
        key, step = low, step * 2
    starts = np.flatnonzero(np.arange(n) + unit.length <= stops)
    if not len(starts):
        return None
    sample = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1) | (stops[starts[1:]] != stops[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    lo, end, at = starts[first], starts[last] + unit.length, sample[first]
    return lo, end, names_of(one, at, at + unit.length - unit.cover + 1), names_of(two, lo, end, UNBASE_2)


def _word_values(one: np.ndarray, two: np.ndarray, text: np.ndarray, at: np.ndarray):
    starts, stops, bounds = word_edges(text, at)
    return names_of(one, starts, stops), names_of(two, starts, stops, UNBASE_2), bounds


def _long_words(text: np.ndarray):
    """Word values of a text in pieces that end at white space."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        if stop < len(text):
            gaps = np.flatnonzero(BLANK[text[start:stop]])
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
            else:  # within one word: up to where it ends
                ahead = BLANK[text[stop:]]
                stop = stop + int(ahead.argmax()) if ahead.any() else len(text)
        part = text[start:stop]
        yield _word_values(*_byte_sums(part), part, np.array([0, len(part)]))[:2]
        start = stop


def _word_sums(one: np.ndarray, two: np.ndarray):
    return prefix_sums(one), prefix_sums(two, BASE_2)


def _texts(batch, units: tuple[Unit, Unit]):
    """(unit, first row, offsets in the step, sums, sums, offset in the text) in steps; a long text in
    overlapping pieces."""
    bytes_, words = units
    offsets, data = buffers(batch.column("text"))
    for i, j in steps(offsets):
        size = int(offsets[j] - offsets[i])
        text = data[offsets[i]:offsets[j]]
        if j - i == 1 and size > PIECE:
            for start in range(0, size, PIECE):
                stop = min(size, start + PIECE + bytes_.length - 1)
                yield bytes_, i, np.array([0, stop - start]), *_byte_sums(text[start:stop]), start
            done, tail = 0, (np.zeros(0, np.uint64),) * 2
            for new in _long_words(text):
                part = [np.concatenate(x) for x in zip(tail, new)]
                yield words, i, np.array([0, len(part[0])]), *_word_sums(*part), done - len(tail[0])
                done += len(new[0])
                tail = [x[max(0, len(x) - words.length + 1):] for x in part]
        else:
            at = offsets[i:j + 1] - offsets[i]
            sums = _byte_sums(text)
            yield bytes_, i, at, *sums, 0
            one, two, bounds = _word_values(*sums, text, at)
            yield words, i, bounds, *_word_sums(one, two), 0


def _dealt(unit: int, rows: np.ndarray, buckets: int):
    """A row of bytes for each bucket."""
    if not len(rows):
        return
    where = (rows["name"] % np.uint64(buckets)).astype(np.int64)
    rows, where = rows[order := np.argsort(where, kind="stable")], where[order]
    cut = np.flatnonzero(np.diff(where)) + 1
    parts = np.split(rows, cut)
    yield pa.RecordBatch.from_arrays([pa.array([unit] * len(parts), pa.int32()), pa.array(where[np.concatenate([[0], cut])], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["unit", "bucket", "rows"])


def _settled(unit: int, rows: np.ndarray, buckets: int):
    """Rows that are known to be found twice: they travel under negative buckets, unjudged, in parts."""
    parts = [rows[k:k + PART] for k in range(0, len(rows), PART)]
    if parts:
        where = [-1 - int(x["full"][0] % np.uint64(buckets)) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array([unit] * len(parts), pa.int32()), pa.array(where, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["unit", "bucket", "rows"])


def _groups(rows: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order, which begin a group of equals, which are found twice, which stand for the rest).

    Two holders stand for a group; one that is alone stands with all its rows. Holders are documents
    if ``apart``, else rows.
    """
    keys = ("lo", "tag", "id", "full", "name") if apart else ("full", "name")
    rows = rows[np.lexsort([rows[k] for k in keys])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["name"][1:] != rows["name"][:-1]) | (rows["full"][1:] != rows["full"][:-1])
    holder = np.ones(len(rows), bool)
    if apart:
        holder[1:] = new[1:] | (rows["id"][1:] != rows["id"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(rows)))
    number = np.cumsum(holder)
    place = number - np.repeat(number[first], count)
    twice = np.repeat(np.add.reduceat(holder.astype(np.int64), first) > 1, count)
    return rows, new, twice, ~twice | (holder & (place < 2))


def _spans(unit, ids, tags, open_, lo, end):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(np.full(len(ids), unit, np.int32)), pa.array(np.full(len(ids), open_)), pa.array(lo, pa.int32()), pa.array(end, pa.int32())], ["id", "tag", "unit", "open", "lo", "end"])


def _sent(units, made: dict, buckets: int):
    for unit in units:
        if made[unit]:
            rows, _, twice, stand = _groups(np.concatenate(made[unit]), unit.apart)
            yield from _dealt(unit.number, rows[stand], buckets)
            yield from _settled(unit.number, rows[twice & ~stand], buckets)


def _first(units, buckets: int):
    def run(batches):
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            made = {u: [] for u in units}
            for unit, i, at, one, two, base in _texts(batch, units):
                got = stretches(one, two, np.repeat(at[1:], np.diff(at)), unit)
                if got is None:
                    continue
                lo, end, name, full = got
                doc = np.searchsorted(at, lo, "right") - 1
                out = np.zeros(len(lo), ENTRY)
                out["name"], out["full"], out["id"], out["tag"] = name, full, ids[i + doc], tags[i + doc]
                out["lo"], out["end"] = lo - at[doc] + base, end - at[doc] + base
                made[unit].append(out)
            yield from _sent(units, made, buckets)

    return run


def _by_bucket(batches, dtype, judge, settled):
    """judge() gets all rows of one bucket after another; settled() gets rows of negative buckets."""
    held, now = [], None
    for batch in batches:
        for unit, bucket, rows in zip(batch.column("unit").to_pylist(), batch.column("bucket").to_pylist(), batch.column("rows")):
            rows = np.frombuffer(rows.as_buffer(), dtype)
            if bucket < 0:
                yield from settled(unit, rows)
                continue
            if (unit, bucket) != now and held:
                yield from judge(now[0], np.concatenate(held))
                held = []
            now = unit, bucket
            held.append(rows)
    if held:
        yield from judge(now[0], np.concatenate(held))


def _second(units):
    """Stretches of a bucket: those found twice; and, where a name has different ones, those that stand
    for each."""
    def judge(unit, rows):
        rows, new, twice, stand = _groups(rows, units[unit].apart)
        kind = rows["name"]
        head = np.ones(len(rows), bool)
        head[1:] = kind[1:] != kind[:-1]
        at = np.flatnonzero(head)
        different = np.repeat(np.add.reduceat(new.astype(np.int64), at) > 1, np.diff(np.append(at, len(rows))))
        for some, open_ in ((rows[twice], False), (rows[different & (stand if units[unit].apart else new)], True)):
            if len(some):
                yield _spans(unit, some["id"], some["tag"], open_, some["lo"], some["end"])

    def settled(unit, some):
        yield _spans(unit, some["id"], some["tag"], False, some["lo"], some["end"])

    return lambda batches: _by_bucket(batches, ENTRY, judge, settled)


def _windows(unit: Unit, text: np.ndarray, lo: np.ndarray, end: np.ndarray):
    """(starts, names, fulls) of all windows of the stretches, sorted by lo, a long text piece by piece."""
    words = [np.concatenate(x) for x in zip(*_long_words(text))] if unit.number else None
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(lo, lo[i] + PIECE)))
        base, stop = int(lo[i]), int(end[i:j].max())
        one, two = _word_sums(words[0][base:stop], words[1][base:stop]) if unit.number else _byte_sums(text[base:stop])
        size = end[i:j] - lo[i:j] - unit.length + 1
        at = np.repeat(lo[i:j] - base, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.unique(at)
        yield at + base, names_of(one, at, at + unit.length), names_of(two, at, at + unit.length, UNBASE_2)
        i = j


def _third(units, buckets: int):
    """Windows of open stretches, named with their whole text at hand."""
    def run(batches):
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            offsets, data = buffers(batch.column("text"))
            made = {u: [] for u in units}
            for k, spans in enumerate(batch.column("spans")):
                flat = spans.values
                kind, los, ends = (flat.field(x).to_numpy().astype(np.int64) for x in ("unit", "lo", "end"))
                for unit in units:
                    lo, end = los[kind == unit.number], ends[kind == unit.number]
                    order = np.argsort(lo, kind="stable")
                    for at, name, full in _windows(unit, data[offsets[k]:offsets[k + 1]], lo[order], end[order]) if len(lo) else ():
                        out = np.zeros(len(at), WINDOW)
                        out["name"], out["full"], out["id"], out["tag"], out["lo"] = name, full, ids[k], tags[k], at
                        made[unit].append(out)
            yield from _sent(units, made, buckets)

    return run


def _fourth(units):
    def emit(unit, some):
        if len(some):  # neighbours in a text become one span
            length = units[unit].length
            some = some[np.lexsort((some["lo"], some["tag"], some["id"]))]
            new = np.ones(len(some), bool)
            new[1:] = (some["id"][1:] != some["id"][:-1]) | (some["tag"][1:] != some["tag"][:-1]) | (some["lo"][1:] > some["lo"][:-1] + length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(some)) - 1
            yield _spans(unit, some["id"][first], some["tag"][first], False, some["lo"][first], some["lo"][last] + length)

    def judge(unit, rows):
        rows, _, twice, _ = _groups(rows, units[unit].apart)
        yield from emit(unit, rows[twice])

    return lambda batches: _by_bucket(batches, WINDOW, judge, emit)


def merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    if not len(lo):
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


def _last(batches):
    for batch in batches:
        offsets, data = buffers(batch.column("text"))
        out: list[list] = [[], [], [], [], [], []]
        for k, spans in enumerate(batch.column("spans")):
            text = data[offsets[k]:offsets[k + 1]]
            found = [(np.zeros(0, np.int32),) * 2] * 2
            if spans.is_valid:
                flat = spans.values
                kind, los, ends = (flat.field(x).to_numpy() for x in ("unit", "lo", "end"))
                found = [merged(los[kind == u], ends[kind == u]) for u in (0, 1)]
            lo, end = found[0]
            kept, done = hashlib.sha256(), 0
            for a, b in zip(lo.tolist(), end.tolist()):
                kept.update(text[done:a])
                done = b
            kept.update(text[done:])
            out[0].append(len(text))
            out[1].append(int((end - lo).sum()))
            out[2].append(len(lo))
            out[3].append(kept.hexdigest())
            out[4].append(int((found[1][1] - found[1][0]).sum()))
            out[5].append([{"lo": a, "end": b} for a, b in zip(lo.tolist(), end.tolist())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column("real_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage_words: int = 51) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words,
    spans (of bytes).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or
    another; matches do not cross texts and are judged on the input. n_passage_words counts the words
    (runs without ASCII white space) inside any ``passage_words`` consecutive words that a document of
    another id or text also holds; nothing is removed for them. A null text counts as empty; texts
    shorter than a length lose nothing; null ids and repeated rows are documents like others (two
    equal rows of ``length`` bytes lose all; for passages they are one document). An empty table gives
    an empty result. Other columns are not read. ``length`` is at least twice the cover.
    """
    units = units_of(length, passage_words)
    n = 2 * partitions(docs.sparkSession)  # a task sorts two buckets of each unit, one at a time
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("real_id"), text.alias("text"))
    # equal rows have equal keys, and equal spans
    rows = rows.select("real_id", F.coalesce("real_id", F.lit(-1)).alias("id"), F.xxhash64("text", F.col("real_id").isNull()).alias("tag"), "text")
    keyed = rows.where(F.octet_length("text") >= min(length, 2 * passage_words - 1)).select("id", "tag", "text")
    sorted_ = lambda df: df.repartition(n // 2, "unit", "bucket").sortWithinPartitions("unit", "bucket")
    judged = stage(sorted_(keyed.mapInArrow(_first(units, n), ROWS)).mapInArrow(_second(units), SPANS), "stretches")
    gathered = lambda df: df.groupBy("id", "tag").agg(F.collect_list(F.struct("unit", "lo", "end")).alias("spans")).hint("shuffle_hash")
    # real_id goes along unused, so that both joins read one exchange of the texts
    named = rows.join(gathered(judged.where("open")), ["id", "tag"]).select("real_id", "id", "tag", "text", "spans").mapInArrow(_third(units, n), ROWS)
    found = sorted_(named).mapInArrow(_fourth(units), SPANS)
    spans = gathered(judged.where("not open").union(found))
    return rows.join(spans, ["id", "tag"], "left").select("real_id", "text", "spans").mapInArrow(_last, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, spans array<struct<lo: int, end: int>>")


def op4(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
