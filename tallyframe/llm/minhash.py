"""Near-duplicate documents: SuperMinHash signatures, banding, verification, components.

Copies of one shingle set are collapsed first. Bands make buckets; in each the smallest id is compared
with all others (a star, never all pairs), and verified links are united. Where a bucket still holds
several components, its members of different components are compared by signature, in blocks, and what
may reach the threshold is verified on full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, LOWER, buffers, fresh, least_row, mix, names_of, partitions, prefix_hash, released, stage, steps, without, word_edges
from .components import components

_lower = np.frombuffer(LOWER, np.uint8)
#: Signature: bands of rows, so many bands that a pair just at the threshold shares none at most this
#: often: 28 at a similarity of 0.85, 44 at 0.8.
ROWS, MISSED = 6, 2e-6
#: Members of a bucket that meet at a time.
BLOCK = 1024
#: Shingles signed at a time (or those of one set); each has a permutation of bands * rows places.
SIGNED = 25_000


def shingle_sets(array, width: int):
    """(i, sorted distinct 64-bit shingle hashes) of every row.

    Words are runs of bytes that are not ASCII white space, A-Z lower-cased. A text of fewer words
    than ``width`` has one shingle, all its words; without words it has none.
    """
    offsets, data = buffers(array)
    for i, j in steps(offsets):
        at = offsets[i:j + 1] - offsets[i]
        text = _lower[data[offsets[i]:offsets[j]]]
        starts, stops, bounds = word_edges(text, at)
        words = names_of(prefix_hash(text), starts, stops)
        grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            grams = mix(grams * np.uint64(3) + words[k:k + len(grams)] + np.uint64(k + 1))
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= width:
                yield i + k, np.unique(grams[a:b - width + 1])
            else:
                one = np.zeros(min(1, b - a), np.uint64)
                for w in range(a, b):
                    one = mix(one * np.uint64(5) + words[w:w + 1] + np.uint64(77))
                yield i + k, one


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: an element gives its j-th value, j plus a random fraction, to the j-th place of a
    random permutation of its own; a document stops once no later value could be smaller."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full(len(sets) * m, ~np.uint64(0))
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    docs = np.repeat(np.arange(len(sets)), sizes)
    perms = None
    for j in range(m):
        if not len(elements):
            break
        random = mix(elements + np.uint64((j * 0x9E3779B97F4A7C15 + 1) % 2**64))
        pick = j + ((random >> np.uint64(48)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if j == 0:
            place = first = pick
        else:
            rows = np.arange(len(elements))
            place = perms[rows, pick]
            perms[rows, pick] = perms[:, j]
            perms[:, j] = place
        np.minimum.at(out, docs * m + place, np.uint64(j << 48) | (random & np.uint64((1 << 48) - 1)))
        active = (out.reshape(-1, m).max(1) >= np.uint64(j + 1 << 48))[docs]
        if j == 0:
            elements, docs, first = elements[active], docs[active], first[active]
            perms = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            rows = np.arange(len(elements))
            perms[rows, first] = 0
            perms[:, 0] = first
        elif not active.all():
            elements, docs, perms = elements[active], docs[active], perms[active]
    return out.reshape(-1, m)


def _signed(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            held: list[np.ndarray] = []

            def flush():
                if not held:
                    return
                full = mix(signatures(held, bands * rows))  # noqa: B023
                keys = np.zeros((len(held), bands), np.uint64)  # noqa: B023
                for k in range(rows):
                    keys = mix(keys * np.uint64(3) + full[:, k::rows] + np.arange(bands, dtype=np.uint64))
                for s, sketch, key in zip(held, (full & np.uint64(255)).astype(np.uint8), keys.view(np.int64)):  # noqa: B023
                    out[0].append(len(s))  # noqa: B023
                    out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())  # noqa: B023
                    out[2].append(sketch.tobytes())  # noqa: B023
                    out[3].append(key.tobytes())  # noqa: B023
                held.clear()  # noqa: B023

            total = 0
            for _, s in shingle_sets(batch.column("text"), width):
                held.append(s)
                total += len(s)
                if total > SIGNED:
                    flush()
                    total = 0
            flush()
            flat = pa.array(np.frombuffer(b"".join(out[3]), np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), lists], ["id", "n", "set", "sketch", "bands"])

    return run


def _likely(least: float):
    """Keeps edges whose sketches agree in at least this share of places."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                good = (a == b).mean(1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others (none empty)."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sizes = np.fromiter(map(len, many), np.int64, len(many))
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _block_links(least: float, percent: int):
    """Of rows sorted by block pair: verified links between members of different components.

    A pair that shares several buckets is judged in that of its first band only. Sketches rule out
    most pairs, full sets decide on the rest; no pair leaves the block but a link.
    """
    def links(rows):
        ids, comps, part = (np.array([r[c] for r in rows]) for c in ("id", "comp", "part"))
        band, apart = rows[0]["band"], rows[0]["left"] != rows[0]["right"]
        sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
        earlier = np.array([r["bands"][:band] for r in rows], np.int64).reshape(len(rows), -1)
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        for k in range(len(rows) - 1):
            near = comps[k + 1:] != comps[k]
            near &= np.minimum(sizes[k + 1:], sizes[k]) * 100 >= percent * np.maximum(sizes[k + 1:], sizes[k])
            if apart:
                near &= part[k + 1:] != part[k]
            near = np.flatnonzero(near) + k + 1
            near = near[(sketch[near] == sketch[k]).mean(1) >= least]
            near = near[~(earlier[near] == earlier[k]).any(1)]
            if len(near):
                both = _shared(sets[k], [sets[x] for x in near])
                near = near[100 * both >= percent * (sizes[k] + sizes[near] - both)]
                if len(near):
                    yield np.minimum(ids[near], ids[k]), np.maximum(ids[near], ids[k])

    def run(batches):
        held, key, found = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["bucket"], row["left"], row["right"])) != key:
                    found += links(held) if len(held) > 1 else []
                    held, key = [], now
                held.append(row)
        found += links(held) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    return run


def _as_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for _, s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _links(percent: int):
    """Edges whose full sets have percent * union <= 100 * intersection."""
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa"), batch.column("sb")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = int(_shared(a, [b])[0]) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the ids named (distinct, staged), staged; only their texts are fetched."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stage(docs.join(ids, "id", "left_semi").mapInArrow(released(_as_sets(width)), "id long, shingles binary"), "sets")


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The least number of bands by which a pair at the threshold is missed at most MISSED often."""
    apart = 1 - (percent / 100) ** rows
    bands = math.ceil(math.log(MISSED) / math.log(apart)) if apart > 0 else 1
    if bands * rows > 1 << 16:
        raise ValueError(f"a threshold of {percent} % needs {bands} bands of {rows}; take fewer rows")
    return bands


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Links need 100 * intersection >= percent * union of the shingle sets; components are their closure.
    A null or empty text has no shingles and stands alone, as does a row with a null id (its
    component_id is null and it is kept). Rows that repeat an id are one document and linked as any of
    their texts is. An empty table gives an empty result. Other columns are not read. Without ``bands``,
    the threshold gives their number.
    """
    bands = bands or bands_for(percent, rows)
    m = bands * rows
    least = percent / 100 - 4.5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / m))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = stage(texts.mapInArrow(released(_signed(width, bands, rows)), "id long, n long, set binary, sketch binary, bands array<long>"), "signatures")
    sound = base.where("id is not null and n > 0")
    firsts = sound.groupBy("set").agg(F.min("id").alias("rep"))
    nodes = stage(sound.join(firsts.select("set", F.col("rep").alias("id")), ["set", "id"]).dropDuplicates(["id", "set"]).select("id", "sketch", "bands"), "nodes")
    members = nodes.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "band", "id")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1")
    members = stage(members.join(shared, "bucket"), "buckets")
    sketches = nodes.select("id", "sketch")

    copies = sound.select("id", "set").join(firsts, "set").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # first round: stars
    stars = members.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    left, right = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    # members first: a member has few edges, a centre may have very many; a skewed centre is split by AQE
    near = stars.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "sketch_a", "sketch_b")
    edges = stage(near.mapInArrow(_likely(least), "a long, b long"), "candidates")
    sets = _sets_of(stage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "named"), texts, width)
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "sa"), ("b", "sb")))
    full = edges.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "sa", "sb")
    links = stage(full.mapInArrow(released(_links(percent)), "a long, b long"), "links")
    comps = components(links)
    # second round: buckets whose members are still in several components
    labelled = stage(members.join(comps, "id", "left").select("bucket", "band", "id", "size", F.coalesce("comp", "id").alias("comp")), "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    met = stage(labelled.join(open_, "bucket", "left_semi"), "open")
    sets = _sets_of(stage(met.select("id").distinct(), "named"), texts, width)
    parts = F.ceil(F.col("size") / F.lit(BLOCK))
    dealt = met.join(nodes, "id").join(sets, "id").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("bucket", "band", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "id", "comp", "sketch", "bands", "shingles")
    more = stage(dealt.repartition(partitions(docs.sparkSession), "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "id").mapInArrow(released(_block_links(least, percent)), "a long, b long").distinct(), "links")
    final = components(links.union(more).union(copies))
    out = base.select("id", "n").join(final, "id", "left")
    comp = F.coalesce("comp", "id")
    return out.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id").isNull() | (F.col("id") == comp)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, whole: of each component the smallest id; rows with a null id stay.

    A row goes by its id, so that texts that stay need not move. Of rows that repeat an id, the least
    by text and then by all columns stays, if the id does.
    """
    judged = near_duplicates(docs, id_col, text_col, **settings).where("id is not null")
    ids = judged.groupBy("id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 or not kept")
    gone = stage(ids.select("id", (F.col("kept") & (F.col("n") > 1)).alias("again")), "gone")
    once = docs.where(F.col(id_col).cast("long").isNull()).union(without(docs, id_col, gone.select("id")))
    if gone.where("again").isEmpty():
        return once
    name = fresh(docs, "id")
    found = docs.join(gone.where("again").select(F.col("id").alias(name)), F.col(id_col).cast("long") == F.col(name))
    return once.union(least_row(found, [name], docs.columns, text_col))


def op1(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
