"""Edge cases of every operator, and brute-force comparisons on small tables."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyframe.llm import bpe, decontaminate, exact_dedup, language, line_dedup, minhash, quality, repeats, token_counts, warc
from tallyframe.llm.components import components
from tallyframe.llm.fmindex import FMIndex, suffix_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, spans string, row long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"passage{i} of" for i in range(60))


def docs_of(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", 7) for i, t in rows], SCHEMA)


ROWS = [(1, "Alpha beta gamma delta"), (2, "alpha BETA gamma delta"), (3, None), (4, ""), (5, "É alpha"), (5, "É alpha"), (None, "no id here"), (None, None), (6, LONG), (7, LONG + " x"), (8, " \n\t "), (9, PASSAGE), (10, "before " + PASSAGE + " after")]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.exact_dedup(docs, keep="max").collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    for r in got:
        assert r.group_size in {len(v) for v in groups.values()}
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    by_id = {r.id: r for r in got if r.id is not None}
    assert (by_id[1].keep_id, by_id[1].kept, by_id[2].kept) == (2, False, True)
    assert by_id[4].keep_id == 4 and by_id[4].group_size == 3  # null texts count as empty, null ids lose
    assert exact_dedup.exact_dedup(none).count() == 0
    stays = exact_dedup.drop_exact_copies(docs)
    assert stays.columns == docs.columns and stays.count() == len(groups)


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(300)]
    got = {r.id: r for r in exact_dedup.exact_dedup(docs_of(spark, rows), fan=2).collect()}
    assert got[4].keep_id == 1 and got[4].group_size == 200 and sum(r.kept for r in got.values()) == 101


def test_exact_dedup_many_batches_in_a_node(spark):
    from contextlib import contextmanager

    @contextmanager
    def batches_of(n):
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(name)
        spark.conf.set(name, str(n))
        try:
            yield
        finally:
            spark.conf.set(name, before)

    rows = [(i, "same" if i % 3 == 0 else f"t{i % 170}") for i in range(500)] + [(None, "same"), (9, "same"), (600, None), (601, "")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for n in (1, 2, 7):
        for keep in (min, max):
            with batches_of(n):
                got = exact_dedup.exact_dedup(docs_of(spark, rows), keep=keep.__name__, fan=2).collect()
            want = sorted((-1 if i is None else i, keep(x for x in groups[t or ""] if x is not None), len(groups[t or ""])) for i, t in rows)
            assert sorted((-1 if r.id is None else r.id, r.keep_id, r.group_size) for r in got) == want
            assert sum(r.kept for r in got) == len(groups)
    # more rows in a leaf than one batch of the default size
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), (F.col("id") % 150_000).cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(many, fan=2).agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"), F.sum("group_size").alias("s")).first()
    assert (got.kept, got.n, got.s) == (150_000, 200_000, 100_000 + 4 * 50_000)


CLASH = "doc_id long, text string, __id long, __digest string, _own_spans int, spans string, items int, n_words long, n_chars long, row string, kept string, n int"


def test_forms_that_keep_documents(spark, monkeypatch):
    """Repeated rows, clashing names and nulls in every column; the result is the same without broadcasts."""
    from tallyframe.llm import common

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text.upper()), (3, text + " x"), (4, None), (5, ""), (6, "left alone"), (6, "left alone"), (6, "LEFT alone"), (7, "a b"), (7, "c d"), (None, "anon"), (None, "Anon"), (None, "anon"), (8, PASSAGE)]
    rows = [(i, t, *([None] * 6 if k % 2 else [k, "d", k, "s", k, k]), 3, "r", "k", None) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, CLASH)
    want_exact = {(1, text), (3, text + " x"), (4, None), (6, "LEFT alone"), (7, "a b"), (7, "c d"), (None, "Anon"), (8, PASSAGE)}
    want_near = {(1, text), (4, None), (5, ""), (6, "LEFT alone"), (7, "a b"), (None, "anon"), (None, "Anon"), (8, PASSAGE)}
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for limit in (common.BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        monkeypatch.setattr(minhash, "BROADCAST_IDS", limit)
        for run, want in ((exact_dedup.drop_exact_copies, want_exact), (minhash.drop_near_copies, want_near), (lambda d: decontaminate.strip_contamination(d, bench), {(r[0], r[1]) for r in rows[:-1]})):
            out = run(docs)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            got = [tuple(r) for r in out.collect()]
            assert {r[:2] for r in got} == want and {str(r) for r in got} <= {str(r) for r in rows}
    assert len(got) == len(rows) - 1


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def linked(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    low = {i: i for i in sets}
    change = True
    while change:
        change = False
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                change = True
    return sets, low


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        if i % 4 == 0 or not rows:
            words = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        else:
            words = list(rng.choice(rows)[1].split())
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    for width, percent in ((3, 85), (5, 80)):
        sets, low = linked(rows, width, percent)
        got = {r.id: r for r in minhash.near_duplicates(docs_of(spark, rows), width=width, percent=percent).collect()}
        assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == {i: (len(sets[i]), low[i]) for i in sets}


def test_bands_follow_the_threshold(spark):
    for percent in (50, 80, 85, 95):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent) <= minhash.MISSED
    assert (minhash.bands_for(85), minhash.bands_for(80), minhash.bands_for(100)) == (28, 44, 1)
    words = [f"s8434w{i}" for i in range(100)]  # a similarity of 0.8 and none of 28 bands in common
    got = minhash.near_duplicates(docs_of(spark, [(1, " ".join(words[:90])), (2, " ".join(words[10:]))]), width=1, percent=80).collect()
    assert {r.component_id for r in got} == {1}


def test_near_duplicates_edges(spark, docs, none):
    got = minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert len(got) == len(ROWS)
    by_id = {r.id: r for r in got if r.id is not None}
    assert (by_id[2].component_id, by_id[7].component_id, by_id[4].n_shingles, by_id[4].component_id) == (1, 6, 0, 4)
    assert all(r.kept and r.component_id is None for r in got if r.id is None)
    assert minhash.near_duplicates(none).count() == 0
    stays = minhash.drop_near_copies(docs)
    assert stays.columns == docs.columns and stays.where("doc_id = 5").count() == 1 and stays.where("doc_id is null").count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(pool[:600]), np.unique(pool[100:700]), pool[:0], np.unique(pool[:3])]
    sign = minhash.signatures(sets, 168)
    assert abs((sign[0] == sign[1]).mean() - 500 / 700) < 0.12
    assert (minhash.signatures(sets[:1], 168) == sign[:1]).all()
    assert len(set(sign[3].tolist())) == 168  # a small set still fills every place


def test_signing_holds_few_permutations():
    """Many texts in a batch, none of which stops early: memory follows the shingles signed at a time."""
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(150)) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    run = minhash._signed(5, 44, 6)
    whole = pa.Table.from_batches(run([batch]))
    tracemalloc.start()
    apart = pa.Table.from_batches(run(batch.slice(i, 7) for i in range(0, len(texts), 7)))
    few = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.to_pylist() == apart.to_pylist()
    assert peak < 60e6, (few, peak)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (200, 100)], "a long, b long").repartition(5)
    got = {r.id: r.comp for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[200] == 100
    assert components(edges.limit(0)).count() == 0


def test_lines(spark, docs, none):
    got = line_dedup.duplicate_lines(docs).collect()
    assert len(got) == len(ROWS)
    tiny = docs_of(spark, [(1, "the quick brown fox jumps over\nabc\n\nabc"), (2, "the quick brown fix jumps over"), (3, "the quick brown fx jumps over"), (4, None), (6, "the quick brown fox jumps overs\nother line of more than twenty")])
    by_id = {r.id: r for r in line_dedup.duplicate_lines(tiny).collect()}
    assert (by_id[1].n_lines, by_id[1].n_exact, by_id[1].dropped) == (3, 1, [3])
    assert by_id[2].n_near == 1 and by_id[3].n_near == 1 and by_id[6].dropped == [0] and by_id[4].n_lines == 0
    assert line_dedup.duplicate_lines(none).count() == 0


def test_short_lines_match_brute_force(spark):
    rng = random.Random(8)
    pick = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 8, 19, 20)))) if rng.random() < 0.6 or not seen else rng.choice(seen)
    seen, rows = [], []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = pick()
            if len(line) > 8 and rng.random() < 0.7:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(("", "x")) + line[at + 1:]
            seen.append(line)
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    before, want = [], {}
    for i, text in rows:
        gone = []
        for k, line in enumerate(text.split("\n")):
            if any(line_dedup.within_one_edit(line, x) for x in before):
                gone.append(k)
            before.append(line)
        want[i] = gone
    assert {r.id: r.dropped for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()} == want


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", True), ("abc", "axc", True), ("abc", "ab", True), ("abc", "bc", True), ("abc", "acb", False), ("", "a", True), ("ab", "abcd", False)])
def test_one_edit(a, b, near):
    assert line_dedup.within_one_edit(a, b) is near


def brute_repeats(rows, length, width=51):
    texts = [(t or "").encode() for _, t in rows]
    count, holders = {}, {}
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t)
    for (i, _), t in zip(rows, texts):
        for k in range(len(t) - length + 1):
            count[t[k:k + length]] = count.get(t[k:k + length], 0) + 1
        w = cut(t)
        for k in range(len(w) - width + 1):
            holders.setdefault(tuple(w[k:k + width]), set()).add((i, t))
    out = []
    for t in texts:
        gone, w = bytearray(len(t)), cut(t)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        shared = {x for k in range(len(w) - width + 1) if len(holders[tuple(w[k:k + width])]) > 1 for x in range(k, k + width)}
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), len(shared)))
    return out


def repeats_of(docs, **settings):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in repeats.repeated_spans(docs, **settings).collect())


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    letter = lambda n, k="abcdefgh": "".join(rng.choice(k) for _ in range(n))
    shared, ragged = letter(900), letter(430)
    rows = [(1, letter(300) + shared + letter(50)), (2, shared[100:]), (3, shared[:405] + "é" + shared[405:]), (4, "a" * 1500), (5, letter(10) + ragged + letter(700)), (6, letter(400) + ragged), (7, letter(399)), (8, "ab" * 500), (8, "ab" * 500), (None, shared[200:700]), (9, None), (10, ""), (11, letter(2000)), (12, letter(600) + letter(20) + ragged[10:420])]
    assert repeats_of(docs_of(spark, rows)) == sorted(brute_repeats(rows, 400))
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs_of(spark, rows), length=100)
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs_of(spark, rows), passage_words=20)


@pytest.mark.parametrize("piece", [4 << 20, 700])
def test_passages_match_brute_force(spark, monkeypatch, piece):
    """Passages of words around the bound, inside and across documents; long texts also in pieces."""
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "of", "the", "lorem", "é", "xxxxxxxxxx"]) + str(rng.randrange(30))
    some = lambda n: [word() for _ in range(n)]
    parts = [some(n) for n in (40, 50, 51, 52, 70, 130)]
    rows = []
    for i in range(40):
        words = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            words += rng.choice(parts) + some(rng.randrange(0, 9))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    own = some(60)
    rows += [(50, " ".join(own + ["x"] + own)), (51, " ".join(own[:50])), (52, "same word " * 100), (53, "z" * 3000), (54, " ".join(parts[5])), (54, " ".join(parts[5])), (None, " ".join(parts[4])), (55, None)]
    if piece == 700:  # workers import the module anew, so small pieces are compared here
        monkeypatch.setattr(repeats, "PIECE", piece)
        units = repeats.units_of(400, 51)
        for i, t in rows:
            text = np.frombuffer((t or "").encode(), np.uint8)
            one, two, _ = repeats._word_values(*repeats._byte_sums(text), text, np.array([0, len(text)]))
            got = [np.concatenate(x) for x in zip(*repeats._long_words(text))] or [one, two]
            assert (got[0] == one).all() and (got[1] == two).all()
            monkeypatch.setattr(repeats, "steps", lambda offsets: [(0, 1)])
            batch = pa.RecordBatch.from_pydict({"text": [t or ""]})
            want, found = {0: set(), 1: set()}, {0: set(), 1: set()}
            for size, into in ((1 << 20, want), (piece, found)):
                monkeypatch.setattr(repeats, "PIECE", size)
                for unit, _, at, a, b, base in repeats._texts(batch, units):
                    got = repeats.stretches(a, b, np.repeat(at[1:], np.diff(at)), unit)
                    for lo, end in zip(*got[:2]) if got else ():
                        into[unit.number] |= {int(x) + base for x in range(lo, end - unit.length + 1)}
            assert want == found
    else:
        assert repeats_of(docs_of(spark, rows)) == sorted(brute_repeats(rows, 400))


def test_repeats_in_a_text_of_megabytes(spark):
    """A text over PIECE, beside one that holds stretches of it over the seam of two pieces."""
    rng = np.random.default_rng(4)
    long = "".join(np.array(list("abcdefghij klmnop"))[rng.integers(0, 17, repeats.PIECE + 300_000)])
    seam = repeats.PIECE
    rows = [(1, long), (2, long[seam - 200:seam + 200]), (3, "x" + long[seam - 2000:seam + 1500] + "y"), (4, long[seam - 199:seam + 200]), (5, long[-450:])]
    got = {r.id: r for r in repeats.repeated_spans(docs_of(spark, rows)).collect()}
    assert [(x.lo, x.end) for x in got[1].spans] == [(seam - 2000, seam + 1500), (len(long) - 450, len(long))]
    assert [(got[i].n_removed, got[i].n_spans) for i in (2, 3, 4, 5)] == [(400, 1), (3500, 1), (0, 0), (450, 1)]
    n = len(rows[2][1].split())
    assert got[3].n_passage_words in range(n - 3, n + 1)


def test_repeats_empty(none):
    assert repeats.repeated_spans(none).count() == 0


@pytest.fixture(scope="module")
def ranks():
    public = pytest.importorskip("public_tokenizers")
    return public, bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_library(ranks):
    import tiktoken

    public, table = ranks
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    encoder = bpe.PrefixEncoder(table)
    tok = bpe.Tokenizer(bpe.BatchEncoder(encoder), public.PATTERN)
    rng = random.Random(2)
    marks = "abcdefé \n\t\r 漢😀٣½²'sT09.!\x00\x1c\x85ßʯ¼€"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(80))) for _ in range(800)] + ["", "a" * 300, " " * 70, LONG, "it's 12x", "\x00a\x00"]
    for text, ids in zip(texts, tok.encode_all(texts)):
        assert ids == library.encode_ordinary(text)
        assert tok.decode(ids) == text.encode()
    for word in ("hello", "preposterousness", "ééé漢字", "x\x00y"):
        whole = bpe.EditableEncoding(encoder, word.encode())
        whole.append("ation".encode())
        whole.replace(1, 3, b"zz")
        fresh = bpe.EditableEncoding(encoder, whole.text)
        assert whole.ids() == fresh.ids() == [table[x] for x in encoder.merge(whole.text)]


def test_bpe_operator(docs, none, ranks):
    public, _ = ranks
    path = public.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.bpe_encode(docs, path, public.PATTERN).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.n_tokens == len(r.token_ids)
    assert bpe.bpe_encode(none, path, public.PATTERN).count() == 0


def test_bpe_encodes_a_piece_once(ranks):
    """In a task a piece that is met again, however much later, is known."""
    public, table = ranks
    tok = bpe.Tokenizer(bpe.BatchEncoder(bpe.PrefixEncoder(table)), public.PATTERN)
    letters = "bcdfghjklmnpqrstvwxz"
    words = ["".join(x) for x in itertools.islice(itertools.product(letters, repeat=5), 240_000)]
    cut = {w for w in words if f" {w}".encode() not in table}
    encode, encoded = tok.batch.encode, []
    tok.batch.encode = lambda *args: encoded.append(len(args[-1])) or encode(*args)
    for i in [*range(0, len(words), 40_000), 0]:
        ids = list(tok.encode_all([" " + " ".join(words[i:i + 40_000])]))
    assert sum(encoded) == len(cut)
    assert tok.decode(ids[0]).decode() == " " + " ".join(words[:40_000])


def test_bpe_splits_as_the_pattern(ranks, monkeypatch):
    """Contractions, blanks and wide characters at the edges of many texts that are split together, pieces
    that are forgotten, pairs that meet in a slot, and long ranges that are hashed by parts."""
    import tiktoken

    public, table = ranks
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    for name, value in (("CACHE_PIECES", 50), ("PAIR_SLOTS", 8), ("JOINED", 16), ("TABLE_BYTES", 64)):
        monkeypatch.setattr(bpe, name, value, raising=False)
    tok = bpe.Tokenizer(bpe.BatchEncoder(bpe.PrefixEncoder(table)), public.PATTERN)
    rng = random.Random(3)
    marks = ["a", "'", "'s", "'re", "'l", "ve", " ", "  ", "\n", "\u3000", "\xa0", "\x1c", "\x85", "\u0301", "\u0663", "5", "\u6f22", "\U0001f600", "."]
    for _ in range(60):
        texts = ["".join(rng.choices(marks, k=rng.randrange(9))) for _ in range(20)]
        want = [library.encode_ordinary(t) for t in texts]
        assert list(tok.encode_all(texts)) == want
        flat, bounds = np.array([x for some in want for x in some], np.int32), bpe.sums(map(len, want))
        assert tok.bytes.hashes(flat, bounds) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        assert tok.digits.hashes(flat, bounds, 1) == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in want]


def test_bpe_of_bytes_that_are_not_utf8(spark, ranks):
    """Each text is read by itself: the first two together would be valid."""
    import tiktoken

    public, table = ranks
    path = public.path("byte_bpe_multi_50k.tiktoken")
    raw = [b"a \xc3", b"\xa9 b", b"\xff\xfe", "é it's".encode(), b"", None]
    texts = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, text binary").coalesce(1)
    for pattern in (public.PATTERN, r"\p{L}+|\d"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        got = {r.k: r for r in bpe.bpe_encode(texts, path, pattern).collect()}
        for k, x in enumerate(raw):
            ids = library.encode_ordinary((x or b"").decode("utf-8", "replace"))
            assert (got[k].token_ids, got[k].n_tokens) == (ids, len(ids))
            assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[k].decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_token_counts(docs, none):
    pieces = {"▁al".encode(): -1.0, "pha".encode(): -2.0, "▁".encode(): -3.0, "a".encode(): -3.0, "ph".encode(): -3.0, "é".encode(): -4.0}
    counter = token_counts.TrieCounter(pieces)

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = []
            for j in range(i):
                score = pieces.get(word[j:i])
                if i - j == 1:
                    score = max(counter.floor, score) if score is not None else counter.floor
                if score is not None:
                    options.append((best[j][0] + score, best[j][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    words = ["▁alpha".encode(), "▁É".encode(), "▁phaé".encode(), b"a", b"\x00\xff"]
    assert counter.counts(words) == [brute(w) for w in words]
    got = {r.doc_id: r for r in token_counts.token_counts(docs, pieces).collect()}
    assert (got[3].n_tokens, got[4].n_pretokens, got[8].n_tokens) == (0, 0, 0)
    assert got[1].n_pretokens == 4 and got[6].n_pretokens == 3000
    assert token_counts.token_counts(none, pieces).count() == 0


def test_fm_index_matches_scan():
    rng = np.random.default_rng(7)
    symbols = rng.integers(0, 5, 400)
    index = FMIndex(symbols, 5, every=4)
    order = suffix_order(np.concatenate([symbols, [0]]))
    assert sorted(order.tolist()) == list(range(401))
    for n in (1, 2, 3, 6):
        patterns = np.unique(rng.integers(1, 5, (40, n)), axis=0)
        start, stop = index.search(patterns)
        for p, a, b in zip(patterns, start, stop):
            where = [i for i in range(400 - n + 1) if (symbols[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == where


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "gamma delta"), (3, None), (4, ""), (None, "no id"), (2, "gamma delta"), (5, "!!!")], "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [tuple(x) for x in by_id[10].spans] == [(1, 121)] and by_id[10].items == [1]
    assert [tuple(x) for x in by_id[2].spans] == [(2, 4)] and by_id[2].items == [2] and by_id[2].n_words == 4
    assert by_id[3].n_words == 0 and by_id[6].spans == []
    anon = [r for r in got if r.text == "no id here"][0]
    assert [tuple(x) for x in anon.spans] == [(0, 2)] and anon.items == []
    again = decontaminate.find_contamination(docs, bench, block_bytes=100).collect()  # block by block
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_contamination(none, bench).count() == 0
    clean = {r.doc_id: r for r in decontaminate.strip_contamination(docs, bench).collect()}
    assert clean[10].text == "before  after" and clean[10].n_chars == len("before  after") and 9 not in clean
    assert clean[1].text == "Alpha beta " and clean[3].text is None and clean[6].text == LONG


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def prose(spark, n=160):
    rng = random.Random(9)
    words = {"en": ["the", "and", "tion", "ing", "over"], "fr": ["que", "eaux", "ment", "été", "dans"], "de": ["und", "sch", "über", "ung", "nicht"]}
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        text = " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(60)) + "."
        rows.append((i, (text.upper().replace(" ", "!! ") if i % 5 == 0 else text), lang, int(i % 5 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_quality(spark, docs, none):
    d = prose(spark)
    model = quality.fit(d.drop("quality"), d.select("doc_id", "quality").where("doc_id % 4 != 2"), max_labelled=100)
    assert len(model.labels) <= 100
    got = quality.score(d, model).where("doc_id % 4 = 2").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.9
    scores = quality.score(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(none, model).count() == 0
    bare = quality.fit(none, d.select("doc_id", "quality").limit(0))
    assert {r.score for r in quality.score(docs, bare).collect()} == {1.0}


def test_language(spark, docs, none):
    d = prose(spark)
    model = language.fit(d.where("doc_id % 4 != 2"), max_texts=30)
    got = language.identify(d, model).where("doc_id % 4 = 2").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    by_id = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert (by_id[3].lang_pred, by_id[4].lang_pred, by_id[8].lang_pred) == ("und", "und", "und") and by_id[5].lang_pred != "und"
    assert language.identify(docs, model, reject=True).where("doc_id = 6").first().lang_pred == "und"
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


def test_warc(spark, tmp_path):
    rows = [
        (1, "http://www.A.com/x/?utm_source=1", 10, "response", 200, {"ETag": "e1", "Date": "d1", "X": "1"}, b"body one\nline"),
        (2, "https://a.com:443/x#f", 5000, "revisit", 304, {"etag": "e1", "Date": "d2", "Content-Length": "0"}, None),
        (3, "a.com/x", 6000, "revisit", 304, {"ETag": "other"}, None),
        (4, "http://b.com/", 5, "revisit", 304, {}, None),
        (5, "http://a.com/x", 9000, "response", 200, {"Last-Modified": "m", "Set-Cookie": "a\nb"}, bytes(range(256)) + b"\r\n\r\nWARC/1.1\n"),
        (6, "http://a.com/x", 9000, "revisit", 304, {"last-modified": "m"}, None),
        (7, None, None, "revisit", 304, None, None),
        (8, "http://a.com/x", 1, "request", None, None, None),
    ]
    d = spark.createDataFrame(rows, warc.RECORD)
    got = {r.record_id: r for r in warc.resolve_revisits(d.withColumn("extra", F.lit(1)), block_seconds=100).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "full", 2: "resolved", 3: "mismatch", 4: "missing", 5: "full", 6: "resolved", 7: "missing", 8: "other"}
    assert got[2].payload == b"body one\nline" and got[2].headers == {"etag": "e1", "date": "d2", "x": "1"} and got[2].source_id == 1
    assert got[6].source_id == 5 and got[6].payload == rows[4][6] and got[1].url_key == "a.com/x" and got[2].extra == 1
    assert warc.resolve_revisits(d.limit(0)).count() == 0
    warc.write_warc(d.where("record_id < 7"), str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {i: (back[i].url, back[i].ts, back[i].kind, back[i].status, back[i].headers, back[i].payload) for i in back} == {r[0]: (*r[1:6], r[6] or b"") for r in rows[:6]}


def test_warc_headers_and_names(spark):
    """Names that differ in case, names used inside, repeated ids and rows, nulls in every column."""
    rows = [
        (1, "a.com", 10, "response", 200, {"ETag": "e", "X-A": "1", "x-a": "2", "n": None}, b"late"),
        (1, "a.com", 5, "response", 200, {"ETAG": "e"}, b"early"),
        (1, "a.com", 5, "response", 200, {"ETAG": "e"}, b"early"),
        (2, "a.com", 20, "revisit", 304, {"ETag": "e", "etag": "e"}, None),
        (3, "a.com", 20, "revisit", 304, {"etag": "e", "Vary": "v", "VARY": "w"}, None),
        (None, "a.com", 1, "revisit", 304, {"etag": "e"}, None),
        (None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, warc.RECORD)
    for name in ("url_key", "outcome", "source_id", "before", "last", "__full", "_w_full", "__source", "a.b", "id", "seen"):
        d = d.withColumn(name, F.lit("mine"))
    out = warc.resolve_revisits(d, block_seconds=3)
    got = out.collect()
    assert out.columns.count("url_key") == 1 and len(got) == len(rows) and all(r["before"] == r["_w_full"] == r["a.b"] == "mine" for r in got)
    by = {(r.record_id, r.ts): r for r in got}
    assert by[(1, 10)].headers == {"etag": "e", "x-a": "1\n2", "n": None}
    assert (by[(2, 20)].outcome, by[(2, 20)].payload) == ("resolved", b"early")
    assert (by[(3, 20)].outcome, by[(3, 20)].payload, by[(3, 20)].headers) == ("resolved", b"early", {"etag": "e", "vary": "w\nv"})
    assert by[(None, 1)].outcome == "missing" and by[(None, None)].outcome == "other"


def test_warc_of_a_crawl(spark, tmp_path):
    """What crawlers write: a gzip member for each record, names as UUIDs, other kinds of records,
    repeated fields, a body in another encoding, and a file that breaks off."""
    import gzip

    def record(kind, name, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-03-01T00:00:0%dZ" % len(name), "Content-Length: %d" % len(block), *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = "Content-Type: text/html; charset=iso-8859-1\r\nSet-Cookie: a=1\r\nset-cookie: b=2, c\r\nETag: \"x\"\r\n\r\ncaf\xe9".encode("latin-1")
    uri = "WARC-Target-URI: http://site.org/p"
    parts = [
        record("warcinfo", "w", b"software: some crawler\r\n\r\nmore\r\n"), record("request", "q", b"GET /p HTTP/1.1\r\nHost: site.org\r\n\r\n", uri),
        record("response", "rr", b"HTTP/1.1 200 OK\r\n" + page, uri), record("revisit", "vvv", b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n", uri),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[2:])[:-30])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(parts[2]) + gzip.compress(parts[3])[:-15])
    got = {r.kind: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "a.warc.gz"))).collect()}
    assert sorted(got) == ["request", "response", "revisit", "warcinfo"] and got["response"].payload == b"caf\xe9"
    assert got["response"].headers["set-cookie"] == "a=1\nb=2, c" and got["warcinfo"].status is None
    assert (got["revisit"].outcome, got["revisit"].payload, got["revisit"].source_id) == ("resolved", b"caf\xe9", got["response"].record_id)
    for name in ("b.warc", "c.warc.gz"):
        assert [r.kind for r in warc.read_warc(spark, str(tmp_path / name)).collect()] == ["response"]


SF = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    from duck import rows_of, sql_rows
    from tallyframe.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        assert rows_of(QUERIES[name](spark, SF)) == sql_rows(sql, SF)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == columns, name
        assert 0 < out.count() <= n
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0, name
    got = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    windows = {tuple(w[i:i + 10]) for w in map(words, bench) for i in range(max(1, len(w) - 9))}
    assert len({r.text.translate(LOW) for r in got}) == len(got)
    for r in got:
        hit = [tuple(w) for w in zip(*(words(texts[r.doc_id])[i:] for i in range(10)))]
        assert (r.text == texts[r.doc_id]) == (not windows.intersection(hit))
