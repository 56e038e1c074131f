"""Exact dedup: sorted digest runs merged up a tree.

Documents are dealt to leaves by a hash of their row. A leaf sorts its digests and keeps one row for
each distinct one. Then, in rounds, every node hands the slices of its run to the nodes of its group
(``fan`` of them) and merges the slices that it gets; after round r a node holds r digits of the digest
space. Each round is one exchange, one spillable sort and one streaming merge, and a text held by a
third of all rows is never more than one row in a run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, each_text, fresh, least_row, partitions, stage, without

KEY = ["digest", "proof", "n_bytes"]
RUN = "digest binary, proof long, n_bytes long, keep_id long, keep_row long, n long, node long"


def _digest(batches):
    for batch in batches:
        sha, proof, size = [], [], []
        for text in each_text(batch.column("text")):
            text = text.translate(LOWER)
            sha.append(hashlib.sha256(text).digest())
            proof.append(xxhash.xxh64_intdigest(text, 7) - (1 << 63))
            size.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(sha, pa.binary()), pa.array(proof, pa.int64()), pa.array(size, pa.int64())], ["id", "row", *KEY])


def _merge(batches):
    """Rows come sorted by key and, in a key, the survivor first; one row leaves for each key."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # a plan may promise that a column has no nulls; the row held over makes no such promise
        table = pa.Table.from_arrays(batch.columns, schema=pa.schema([f.with_nullable(True) for f in batch.schema]))
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in KEY:
            column = table.column(name).combine_chunks()
            if name == "digest":
                raw = np.frombuffer(b"".join(column.to_pylist()), "V32")
            else:
                raw = column.to_numpy()
            new[1:] |= raw[1:] != raw[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(table.column("n").to_numpy(), first)
        table = table.take(pa.array(first)).set_column(table.schema.get_field_index("n"), "n", pa.array(sums, pa.int64()))
        held = table.slice(table.num_rows - 1)
        if table.num_rows > 1:
            yield from table.slice(0, table.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _run(df: DataFrame, n: int, keep: str) -> DataFrame:
    """Deal to ``node`` and merge there."""
    best = F.col("keep_id").desc_nulls_last() if keep == "max" else F.col("keep_id").asc_nulls_last()
    return df.repartitionById(n, F.col("node").cast("int")).sortWithinPartitions(*KEY, best, "keep_row").mapInArrow(_merge, RUN)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan: int = 8) -> DataFrame:
    """One row for each row of ``docs``: row, id, keep_id, keep_row, group_size, kept, digest.

    Texts are equal if identical after lower-casing A-Z; a match needs the SHA-256, a second hash and
    the length. ``keep`` says whether the smallest or the largest id stays. A null text counts as
    empty, and empty texts equal each other; null ids lose to others; of rows that repeat an id and a
    text, exactly one is kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    levels = 1
    while fan**levels < partitions(spark):
        levels += 1
    n = fan**levels
    keyed = stage(rows.mapInArrow(_digest, "id long, row long, digest binary, proof long, n_bytes long"), "digests")
    keyed = keyed.withColumn("node", F.pmod(F.xxhash64("row"), F.lit(n)))
    leaves = _run(keyed.select(*KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"), "node"), n, keep)
    merged = leaves
    slice_ = F.pmod(F.xxhash64(*KEY), F.lit(n))
    for level in range(levels):
        step = fan**level
        digit = lambda c: F.floor(c / F.lit(step)) % F.lit(fan)  # noqa: B023,E731
        merged = _run(merged.withColumn("node", (F.col("node") + (digit(slice_) - digit(F.col("node"))) * F.lit(step)).cast("long")), n, keep)
    groups = merged.select(*KEY, "keep_id", "keep_row", F.col("n").alias("group_size"))
    by_leaf = leaves.select(*KEY, "node").join(groups, KEY)  # a key has a row for each leaf at most
    return keyed.join(by_leaf, [*KEY, "node"]).select("row", "id", "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def op8(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _with_digest(text_col: str, name: str):
    def run(batches):
        for batch in batches:
            sha = [hashlib.sha256(x.translate(LOWER)).digest() for x in each_text(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.binary())], [*batch.schema.names, name])

    return run


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, whole: one for each text; the rules are those of exact_dedup.

    A row goes by its id alone, so that texts that stay need not move. Only rows without an id or with
    a repeated one are told apart by digests; of several that share id and digest, the least by text
    and then by all columns stays. Extra columns may have any names.
    """
    judged = stage(exact_dedup(docs, id_col, text_col, keep).select("id", "digest", "kept"), "judged")
    ids = judged.groupBy("id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = stage(ids.where("n > 1 or id is null or not kept").select("id", (F.col("id").isNull() | (F.col("n") > 1)).alias("unclear")), "gone")
    once = without(docs, id_col, gone.where("id is not null").select("id"))
    if gone.where("unclear").isEmpty():
        return once
    name, mark = fresh(docs, "id"), fresh(docs, "digest")
    stays = judged.join(gone.where("unclear").select("id"), judged["id"].eqNullSafe(gone["id"])).where("kept").select(judged["id"].alias(name), F.col("digest").alias(f"{mark}_")).distinct()
    some = docs.join(gone.where("unclear").select(F.col("id").alias(name)), F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{mark}` binary"])
    found = some.mapInArrow(_with_digest(text_col, mark), schema).join(stays, F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(f"{mark}_")))
    return once.union(least_row(found, [name, mark], docs.columns, text_col))


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
