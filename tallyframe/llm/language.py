"""Language identification: nearest of several centroids per language by cosine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, id_bucket
from .features import centroids, histograms, idf_of, unit, weigh

DIMS = 4096
_letter = regex.compile(r"\p{L}")


@dataclass
class CentroidModel:
    """Bounded: at most per_language centroids of ``dims`` numbers for each of the languages."""

    idf: np.ndarray
    centres: np.ndarray
    names: list[str]
    #: The least cosine with its own centroid that a language's learning texts reach, by quantile.
    floors: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = weigh(counts, self.idf) @ self.centres.T
        best = near.argmax(1)
        return best, np.clip(near[np.arange(len(best)), best], 0, 1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4, max_texts: int = 512, floor_quantile: float = 0.005, dims: int = DIMS) -> CentroidModel:
    """Learn from at most ``max_texts`` texts of each language, those with the smallest id hashes.

    Rows with a null id or language, a null text or an empty one teach nothing; of several texts of an id
    and language, that whose counts come first as bytes counts. The bound is for each language; the
    number of languages is that of the language column. The idf weights are part of this sampled fit.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text != ''")
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.xxhash64("id"), "id"))
    # first in shares of a language, so that no task gets a whole one
    ids = rows.select("id", "lang").distinct().withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64)))
    ids = ids.withColumn("rank", rank("share")).where(F.col("rank") <= max_texts).withColumn("rank", rank()).where(F.col("rank") <= max_texts).select("id", "lang")
    picked = rows.join(F.broadcast(ids), ["id", "lang"])  # max_texts ids for each language

    def run(batches):
        for batch in batches:
            found = []
            for _, _, counts in histograms(batch.column("text"), "letters", dims):
                found += [row.tobytes() for row in np.log1p(counts).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(found, pa.binary())], ["id", "lang", "counts"])

    found = sorted(((r.lang, r.id, bytes(r.counts)) for r in picked.where("id is not null").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang string, counts binary").toLocalIterator()), reverse=True)
    got = sorted({(lang, i): counts for lang, i, counts in found}.items())  # the first of an id comes last
    if not got:
        return CentroidModel(np.ones(dims, np.float32), np.zeros((0, dims), np.float32), [], np.zeros(0))
    langs = np.array([k[0] for k, _ in got], dtype=object)
    damped = np.stack([np.frombuffer(c, np.float16) for _, c in got]).astype(np.float32)
    idf = idf_of(damped)
    x = unit(damped * idf)
    centres, names, floors = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        made = centroids(own, per_language)
        centres.append(made)
        names += [lang] * len(made)
        floors += [float(np.quantile((own @ made.T).max(1), floor_quantile))] * len(made)
    return CentroidModel(idf, np.vstack(centres), names, np.array(floors))


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text", reject: bool = False, undetermined: str = "und") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) for every whole text.

    A null text, one without a letter, and every text if nothing was learned, are ``undetermined``
    with score 0. With ``reject`` so is a text that lies farther from its centroid than nearly all
    texts learned from; else it keeps the nearest language. Like-named columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    dims = len(model.idf)

    def run(batches):
        for batch in batches:
            m, texts = shared.value, batch.column(text_col)
            has = np.array([bool(_letter.search(x.decode("utf-8", "replace"))) for x in each_text(texts)], bool)
            names, score = [undetermined] * batch.num_rows, np.zeros(batch.num_rows)
            if m.names:
                for i, j, counts in histograms(texts, "letters", dims):
                    best, near = m.nearest(counts)
                    good = has[i:j] & (~np.bool_(reject) | (near >= m.floors[best]))
                    score[i:j] = np.where(good, near, 0)
                    names[i:j] = [m.names[b] if g else undetermined for b, g in zip(best, good)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in keep] + ["lang_pred string, score double"]))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(id_bucket("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
