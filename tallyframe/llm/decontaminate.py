"""Benchmark decontamination: an FM-index over each shard of documents answers for benchmark windows.

A shard keeps, of its words, those that the benchmark knows; runs that no window fits into are left
out, and a separator stands for what was. Windows are searched backward through wavelet ranks, their
occurrences located by sampled suffix positions, and overlapping spans merged.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, each_text, fresh, released, stage
from .fmindex import FMIndex

#: Word bytes: digits, small letters and whatever is not ASCII; all others become blanks.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in LOWER)
#: A shard is indexed once it holds so many symbols or has seen so many words.
SHARD_SYMBOLS, SHARD_WORDS = 1 << 19, 1 << 21
_word = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The distinct windows of a block of benchmark items, as symbols, by length."""

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + width]), set()).add(item)
        self.by_length = {}
        for n in sorted(set(map(len, owners))):
            rows = [w for w in owners if len(w) == n]
            self.by_length[n] = (np.array(rows, np.int64), [sorted((x for x in owners[w] if x is not None), key=str) for w in rows])
        self.shortest = min(self.by_length, default=0)


class Shard:
    """Documents until they are indexed: sizes, and the kept symbols with their document and word."""

    def __init__(self):
        self.sizes: list[int] = []
        self.symbols, self.docs, self.places = [], [], []
        self.kept = self.words = 0

    def add(self, ids: np.ndarray, shortest: int) -> None:
        """A document's words as symbols, 0 for unknown ones."""
        doc = len(self.sizes)
        self.sizes.append(len(ids))
        self.words += len(ids)
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        fit = np.flatnonzero(stops - starts >= shortest)
        for a, b in zip(starts[fit].tolist(), stops[fit].tolist()):
            self.symbols += [ids[a:b], [0]]
            self.docs.append(np.full(b - a + 1, doc))
            self.places.append(np.arange(a, b + 1))
            self.kept += b - a + 1

    def hits(self, windows: Windows) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document its merged spans of words [start, stop) and the items found in it."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        items: list[set] = [set() for _ in self.sizes]
        if self.kept:
            docs, places = np.concatenate(self.docs), np.concatenate(self.places)
            index = FMIndex(np.concatenate(self.symbols), len(windows.vocabulary) + 1)
            found: list[list[np.ndarray]] = []
            for n, (patterns, owners) in windows.by_length.items():
                start, stop = index.search(patterns)
                hit = np.flatnonzero(stop > start)
                count = (stop - start)[hit]
                which = np.repeat(hit, count)
                rows = np.repeat(start[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(hit) else np.zeros(0, np.int64)
                at = index.locate(rows)
                doc, place = docs[at], places[at]
                for pair in np.unique(np.stack([doc, which], 1), axis=0).tolist() if len(at) else []:
                    items[pair[0]].update(owners[pair[1]])
                found.append([doc, place, place + n])
            doc, start, stop = (np.concatenate(x) for x in zip(*found))
            for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()):
                spans[d].append((a, b))
            spans = [merge_spans(x) if x else x for x in spans]
        return spans, items


NEW = ("n_words", "spans", "items")
#: Item ids of these types stay as they are; others are listed as text.
ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
HITS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _search(docs: DataFrame, windows: Windows, id_type: str, after=None) -> DataFrame:
    """``docs`` with n_words, spans and items; what an earlier block found there is merged in.

    after: a function of each finished batch, to columns of ``docs`` alone, run in the same worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    kind = ID_TYPES[id_type]
    keep = [c for c in docs.columns if c not in NEW]
    before = "spans" in docs.columns

    def finish(shard, block, batch):
        spans, items = shard.hits(block)
        if before:
            spans = [merge_spans([*a, *((x["start"], x["stop"]) for x in b)]) for a, b in zip(spans, batch.column("spans").to_pylist())]
            items = [a.union(b) for a, b in zip(items, batch.column("items").to_pylist())]
        new = [pa.array(shard.sizes, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], HITS), pa.array([sorted(x, key=str) for x in items], pa.list_(kind))]
        done = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *NEW])
        return after(done) if after else done

    def run(batches):
        block = shared.value
        get = block.vocabulary.get
        for batch in batches:
            shard, done = Shard(), 0
            for k, text in enumerate(each_text(batch.column("text"))):
                found = words_of(text)
                shard.add(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)), max(1, block.shortest))
                if shard.kept > SHARD_SYMBOLS or shard.words > SHARD_WORDS:
                    yield finish(shard, block, batch.slice(done, k + 1 - done))
                    shard, done = Shard(), k + 1
            if done < batch.num_rows:
                yield finish(shard, block, batch.slice(done))

    extra = [] if after else ["n_words long, spans array<struct<start: long, stop: long>>", f"items array<{id_type}>"]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in keep] + extra)
    return docs.mapInArrow(released(run), schema)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_bytes: int):
    """Blocks of the benchmark of about ``block_bytes`` of text, each brought to the driver by itself.

    A block is what is broadcast, so a benchmark of any size needs bounded memory only: one pass over
    the documents for each block.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield Windows([(r.item, r.text.encode()) for r in part.toLocalIterator()], width)


def find_contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", bench_text_col: str = "text", width: int = 10, block_bytes: int = 8 << 20, after=None) -> DataFrame:
    """``docs`` (its texts in ``text``) with n_words, spans (merged, of words) and items (distinct).

    A window is ``width`` consecutive words of an item, or the whole of a shorter item; words are
    digits, letters and non-ASCII, A-Z lower-cased. A null or empty text has no words and no spans. An
    item without words has no window; one with a null id is searched for but not listed. An empty
    benchmark finds nothing. Columns of ``docs`` with the new names are replaced. A benchmark of more
    than ``block_bytes`` is searched for block by block, with a staged table between.
    """
    found = docs.select(*(c for c in docs.columns if c not in NEW))
    if dict(benchmark.dtypes)[item_col] not in ID_TYPES:
        benchmark = benchmark.withColumn(item_col, F.col(item_col).cast("string"))
    blocks = blocks_of(benchmark, item_col, bench_text_col, width, block_bytes)
    block = next(blocks)
    while block is not None:
        later = next(blocks, None)
        found = _search(found, block, dict(benchmark.dtypes)[item_col], None if later is not None else after)
        found, block = stage(found, "decontaminate") if later is not None else found, later
    return found


def strip_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _word.finditer(text.translate(WORDS))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def strip_contamination(docs: DataFrame, benchmark: DataFrame, chars_col: str = "n_chars", **settings) -> DataFrame:
    """``docs`` without benchmark passages: spans are cut out, ``chars_col`` (if there) counts anew.

    Texts without a hit are left as they are, nulls too; a text that had a hit and keeps no word goes.
    Extra columns stay, those named like the columns that the search adds too.
    """
    names = docs.columns
    docs = docs.withColumnsRenamed({c: f"{fresh(docs, '_own')}_{c}" for c in NEW})
    columns = docs.columns

    def cut(batch):
        spans = batch.column("spans").to_pylist()
        texts, stay = batch.column("text").to_pylist(), []
        for k, own in enumerate(spans):
            if own:
                texts[k] = strip_spans(texts[k].encode(), [(x["start"], x["stop"]) for x in own]).decode()
            stay.append(not own or bool(words_of(texts[k].encode())))
        out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if chars_col in columns:
            counts = [n if not own else len(x) for n, own, x in zip(batch.column(chars_col).to_pylist(), spans, texts)]
            at = batch.schema.get_field_index(chars_col)
            out = out.set_column(at, chars_col, pa.array(counts, batch.schema.field(at).type))
        return out.select(columns).filter(pa.array(stay, pa.bool_()))

    return find_contamination(docs, benchmark, after=cut, **settings).toDF(*names)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.stop - x.start)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
