"""Whole registered queries on the smallest tables against plain versions written apart from them."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import features, language, quality
from tallyframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def column_of(codes, room):
    """The place of one n-gram, in whole numbers of Python."""
    x = len(codes) << 32
    gram = 0
    for c in codes:
        gram = gram << 8 | int(c)
    x = (gram + x) % 2**64
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % 2**64
    return (x ^ x >> 32) % room


def counted(text, kind, dims):
    """Counts of n-grams by a dictionary; what features.histograms does with arrays."""
    raw = text.encode()
    codes = [int((features._shape if kind == "shape" else features._letters)[b]) for b in raw]
    out = np.zeros(dims)
    room = dims - features.LENGTHS if kind == "shape" else dims
    for n in (3,) if kind == "shape" else (1, 2, 3):
        grams = Counter(tuple(codes[i:i + n]) for i in range(len(codes) - n + 1))
        for g, k in grams.items():
            if kind == "shape" or g[0] != 32 or g[-1] != 32:
                out[column_of(g, room)] += k
    if kind == "shape":
        out[room + min(math.ceil(math.log2(len(raw) + 1)), features.LENGTHS - 1)] = 1
    return out


def weighed(counts, idf):
    x = np.log1p(counts) * idf.astype(float)
    return x / (np.sqrt((x * x).sum()) or 1)


def test_quality_votes_are_those_of_all_neighbours(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = quality.fit(docs, learn)
    assert len(model.labels) == learn.count()
    got, judged = result(spark, "op3_quality"), 0
    for i, text in texts.items():
        held = zlib.crc32(str(i).encode()) % 4 == 2
        v = weighed(counted(text, "shape", len(model.idf)), model.idf) @ model.basis.astype(float)
        near = model.vectors.astype(float) @ (v / (np.sqrt((v * v).sum()) or 1))
        order = np.argsort(-near, kind="stable")
        k = min(model.neighbours, len(order))
        assert got[i].held_out == held and got[i].predicted == int(got[i].score >= 0.7)
        if k < len(order) and near[order[k - 1]] - near[order[k]] < 1e-5:
            continue  # which of two equally near ones votes is not defined
        judged += 1
        weight = np.maximum(near[order[:k]], 0) ** model.sharpness
        want = ((weight * model.labels[order[:k]]).sum() + 1e-6 * model.labels.mean()) / (weight.sum() + 1e-6)
        assert got[i].score == pytest.approx(want, abs=2e-3)
    assert judged > 0.8 * len(texts) and len(got) == len(texts)


def test_languages_are_those_of_the_nearest_centroid(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = result(spark, "op7_language")
    assert len(got) == len(texts)
    for i, text in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        near = model.centres.astype(float) @ weighed(counted(text, "letters", len(model.idf)), model.idf)
        assert got[i].score == pytest.approx(min(1, max(0, near.max())), abs=1e-4)
        assert near[[n == got[i].lang_pred for n in model.names]].max() >= near.max() - 1e-5


def test_repeated_rows_teach_the_same_in_any_order(spark):
    rows = [(i, f"{'Good prose, here.' if i % 2 else 'JUNK!!! ;;'} {i}") for i in range(12)] + [(3, "other text of three"), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    models = []
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame(some, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).coalesce(1)
        models.append((quality.fit(d, labels), language.fit(d)))
    assert (models[0][0].vectors == models[1][0].vectors).all() and (models[0][1].centres == models[1][1].centres).all()


def test_token_counts_of_a_whole_vocabulary(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    pieces = {m.id_to_piece(i).encode(): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    floor, longest, known = min(pieces.values()) - 10, max(map(len, pieces)), {}

    def tokens(word):
        if word not in known:
            best = [(0.0, 0)]
            for i in range(1, len(word) + 1):
                ways = [(best[i - 1][0] + floor, best[i - 1][1] - 1)]
                for j in range(max(0, i - longest), i):
                    if (s := pieces.get(word[j:i])) is not None:
                        ways.append((best[j][0] + s, best[j][1] - 1))
                best.append(max(ways))
            known[word] = -best[-1][1]
        return known[word]

    got = result(spark, "op9_token_counts")
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(tokens(("▁" + w).encode()) for w in words))


def test_contamination_by_scan(spark, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got, hits = result(spark, "op10_decontaminate"), 0
    for i, text in texts.items():
        w, hit, items = words(text), set(), set()
        for k, n in itertools.product(range(len(w)), sizes):
            if k + n <= len(w) and (own := windows.get(tuple(w[k:k + n]))):
                hit.update(range(k, k + n))
                items |= own
        hits += bool(hit)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert hits


def test_tokens_are_the_librarys(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    from tallyframe.llm import bpe

    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = result(spark, "op5_byte_bpe")
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_near_copies_by_all_pairs(spark, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        return {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b]) if 100 * min(len(sets[a]), len(sets[b])) >= 85 * max(len(sets[a]), len(sets[b])) else 0
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    got = result(spark, "op1_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, ties and clashing names, stage after stage."""
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, "en", None, None), (-2, "", None, "s", 0), (-2, "", None, "s", 0), (-3, "Ends here.", "en", "s", 10), (-3, "ends HERE.", "en", "s", 10), (-4, " \n ", "en", "s", 3)], good.schema)
    docs = good.union(odd)
    for name in ("__id", "__digest", "__score", "spans", "items", "n_words", "id", "row", "kept", "digest", "__kept"):
        docs = docs.withColumn(name, F.lit("mine"))
    n = docs.count()
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns), name
        assert {tuple(r) for r in out.select("__id", "spans", "row").distinct().collect()} == {("mine",) * 3}, name
        assert out.count() <= n
        if name != "encode":
            assert out.columns == docs.columns
            again = sorted(map(str, out.select("doc_id", "text").collect()))
            assert again == sorted(map(str, step(spark, docs.repartition(7), SF).select("doc_id", "text").collect())), name
