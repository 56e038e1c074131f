import gzip
import itertools
import json

import pytest
from pyspark.sql import functions as F
from tallyframe.config import ProfileConfig
from tallyframe.operators.longform import frequencies, to_long
from tallyframe.plans import emit
from tallyframe.plans.profile import RunFailed, profile_file, profile_table
from tallyframe.plans.store import RunStore
from tallyframe.sources import bytes as raw
from tallyframe.sources import delimited
from tallyframe.sources.dialect import detect_delimiter, detect_quoting, has_bom
from tallyframe.streaming import incremental


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_dialects():
    assert detect_delimiter(b"a|b|c\n1|2|3\n4|5|6\n") == ("|", 1.0)
    assert detect_delimiter(b"a,b\n1,2\n3,4\n")[0] == ","
    assert detect_delimiter(b"") == (",", 0.5)
    assert detect_quoting(b"a|b\n1|2\n", "|") == (False, 0.95)
    assert detect_quoting(b'a|b\n"x|y"|2\n', "|") == (True, 0.98)
    assert has_bom(b"\xef\xbb\xbfa")


def test_strict_rows(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'id|name|amount\n1|"a|b"|2\n2|x\n\n3|x|300|\n4|a|b|c\n5|"two\nlines"|6\n7|"ab"c|8\n9|z|9\n')
    rows = {r._row_id: r for r in delimited.parsed_rows(spark, path, "|", True, 3).collect()}
    assert rows[1].fields == ["1", "a|b", "2"]
    assert [rows[i].error_code for i in (2, 3, 4, 5, 6, 7, 8)] == ["E_JAGGED_ROW", "BLANK", None, "E_UNQUOTED_DELIM", None, "E_QUOTE_RULE", None]
    assert rows[6].fields[1] == "two\nlines"


def test_unquoted_rows_agree(spark, tmp_path):
    path = put(tmp_path, "u.txt", "id,name\n1,a\n2\n3,b,\n4,b,c\n\n5,\"q\n")
    found = delimited.parsed_rows(spark, path, ",", False, 2).orderBy("_row_id").collect()
    assert [r._row_id for r in found] == [1, 2, 3, 4, 5, 6]
    rows = [(r.fields, r.error_code) for r in found]
    assert rows == [(["1", "a"], None), (["2"], "E_JAGGED_ROW"), (["3", "b"], None), (["4", "b", "c"], "E_JAGGED_ROW"), ([""], "BLANK"), (["5", '"q'], None)]


def test_gzip_is_known_by_its_mark(spark, tmp_path):
    """Unquoted and quoted, one member or several, with all line ends; no suffix says what it is."""
    body = "id,name\n" + "".join(f"{i},n{i}\n" for i in range(1, 51))
    packed = gzip.compress(body[:100].encode()) + gzip.compress(body[100:].replace("7\n", "7\r\n").replace("9\n", "9\r").encode())
    for quoted, text in ((False, packed), (True, gzip.compress("".join(f'{x.split(",")[0]},"{x.split(",")[1]}"\n' for x in body.split()).encode()))):
        table, errors, dialect = delimited.read_delimited(spark, put(tmp_path, f"plain{quoted}.csv", text), quoted=quoted)
        got = {r._row_id: (r.id, r.name) for r in table.collect()}
        assert len(got) == 50 and errors.count() == 0 and got[50] == ("50", "n50") and got[7][0] == "7"
        assert dialect["delimiter"] == ","
    pieces = b"".join(raw.unpacked(packed, 16))
    assert pieces == gzip.decompress(packed)
    assert profile_file(spark, str(tmp_path / "plainFalse.csv")).totals.first().total_rows == 50
    (tmp_path / "cut").write_bytes(gzip.compress(body.encode())[:-12])
    with pytest.raises(RunFailed) as failed:
        profile_file(spark, str(tmp_path / "cut"))
    assert failed.value.code == "E_GZIP_DECOMPRESS"


def test_unpacking_ends_with_the_members():
    """Wherever a member's contents end in a piece, what follows it is read once."""
    for n in range(1, 120):
        packed = gzip.compress(bytes(range(n))) + gzip.compress(b"x" * n) + gzip.compress(b"last")
        for size in (1, 16, 100):
            got = b"".join(itertools.islice(raw.unpacked(packed, size), 1000))
            assert got == bytes(range(n)) + b"x" * n + b"last"


@pytest.mark.parametrize("quoted", [False, True])
def test_folder_of_files(spark, tmp_path, quoted):
    """Each file has its header; rows are numbered on; one of the files is packed."""
    mark = '"' if quoted else ""
    text = lambda n, start: "a,b\n" + "".join(f"{mark}{start + i}{mark},x\n" for i in range(n))
    put(tmp_path, "1.csv", text(5, 0))
    put(tmp_path, "2.csv", gzip.compress(text(3, 100).encode()))
    put(tmp_path, "3.csv", text(1, 200))
    put(tmp_path, "4.csv", "a,b\n")
    table, errors, _ = delimited.read_delimited(spark, str(tmp_path), quoted=quoted)
    rows = table.collect()
    assert sorted(r._row_id for r in rows) == list(range(1, 10)) and errors.count() == 0
    assert {r.a for r in rows} == {"0", "1", "2", "3", "4", "100", "101", "102", "200"}


def test_delimiter_confidence():
    assert detect_delimiter(b"a;b\nc;d;e\nf\n") == (";", pytest.approx(1 - (2 / 3) ** 0.5))
    assert detect_delimiter(b"x|y,z\n1|2,3\n4|5,6,7,8\n")[0] in ("|", ",")
    assert detect_delimiter(b"one line only") == (",", 0.5)
    assert detect_delimiter(b"a\tb\tc") == ("\t", 1.0)


def test_file_checks(spark, tmp_path):
    put(tmp_path, "a.csv", b"\xef\xbb\xbfa\r\nb\nc\r\n")
    put(tmp_path, "b.csv", b"ok\nbad \xff byte")
    put(tmp_path, "c.data", gzip.compress(b"x\ry"))
    got = {r.path.rpartition("/")[2]: r for r in raw.file_report(spark, str(tmp_path)).collect()}
    assert got["a.csv"].bom and got["a.csv"].endings.style == "CRLF" and got["a.csv"].endings.mixed
    assert (got["b.csv"].is_valid, got["b.csv"].offset) == (False, 7)
    assert got["c.data"].endings.style == "CR" and got["c.data"].n_bytes == 3


def test_profile_file_and_artifacts(spark, tmp_path):
    text = "id|name|amount|day\n" + "".join(f"{i}|n{i % 3}|{i}.50|202401{i:02d}\n" for i in range(1, 21))
    path = put(tmp_path, "p.csv.gz", gzip.compress(text.encode()))
    seen = []
    p = profile_file(spark, path, ProfileConfig(delimiter=","), lambda share, step: seen.append(share))
    types = {r.name: r.type for r in p.columns.collect()}
    assert types == {"id": "numeric", "name": "code", "amount": "money", "day": "date"}
    assert {e.code for e in p.errors.collect()} == {"W_DELIMITER_MISMATCH"}
    assert seen[0] == 0 and seen[-1] == 100
    assert p.candidate_keys.first()["columns"] == ["id"]
    assert p.duplicates(["name"]).first().duplicate_count == 3
    assert p.compound_keys().count() >= 1
    emit.write_artifacts(p, str(tmp_path / "out"))
    made = json.loads((tmp_path / "out/profile.json").read_text())
    assert made["total_rows"] == 20 and len(made["columns"]) == 4
    assert spark.read.csv(str(tmp_path / "out/metrics.csv"), header=True).columns == emit.METRICS
    assert "<table>" in (tmp_path / "out/report.html").read_text()
    assert emit.read_audit(spark, str(tmp_path / "out/audit.jsonl")).count() == 1


@pytest.mark.parametrize(("data", "code"), [(b"", "E_HEADER_MISSING"), (b"a,b\n1,\xff\n", "E_UTF8_INVALID"), (b"a,b\n1\n2,3\n", "E_JAGGED_ROW"), (b"\x1f\x8bxxxx", "E_GZIP_DECOMPRESS")])
def test_fatal_codes(spark, tmp_path, data, code):
    with pytest.raises(RunFailed) as failed:
        profile_file(spark, put(tmp_path, "f.csv", data))
    assert failed.value.code == code


def test_html_escapes_names(spark):
    p = profile_table(spark.createDataFrame([(1, "<b>")], "_row_id long, `<i>` string"))
    page = emit.html_report(p)
    assert "<i>" not in page and "&lt;b&gt;" in page


def test_audit_takes_no_values(tmp_path):
    log = emit.AuditLog(str(tmp_path / "a.jsonl"), "r")
    with pytest.raises(ValueError):
        log.log("run_completed", rows=["a value"])
    with pytest.raises(ValueError):
        log.log("something_else")


def test_runs(spark, tmp_path):
    store = RunStore(str(tmp_path))
    ids = [store.create(f"s{i}") for i in range(4)]
    store.move(ids[0], "processing", 10)
    store.add(ids[0], "E_X", "m")
    store.add(ids[0], "E_X", "m", 2)
    store.move(ids[0], "completed", 100)
    with pytest.raises(ValueError):
        store.move(ids[0], "processing")
    assert store.load(ids[0])["errors"] == [{"code": "E_X", "message": "m", "count": 3}]
    assert store.newest(spark, 2).count() == 2
    assert store.cleanup(3) == [ids[0]]


def test_stream_and_merge(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("_row_id"), (F.col("id") % 3).cast("string").alias("v"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.streaming_frequencies(stream, ["v"]).writeStream.format("memory").queryName("freqs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.value: r.cnt for r in spark.table("freqs").collect()} == {"0": 7, "1": 7, "2": 6}
    parts = [frequencies(to_long(df.where(F.col("_row_id") % 2 == i))) for i in range(2)]
    assert sorted(map(tuple, incremental.merge_frequencies(*parts).collect())) == sorted(map(tuple, frequencies(to_long(df)).collect()))


def test_large_files_are_read_in_pieces_alike(spark, tmp_path):
    """Split over tasks and joined in order: reports and quoted rows are those of files read whole."""
    import hashlib

    put(tmp_path, "empty", b"")  # a file without bytes has no row

    quoted = "id,name\n" + "".join(f'{i},"n{i}\nsecond, é line"\n' if i % 3 else f"{i},plain\r\n" for i in range(400))
    contents = {
        "mark.csv": b"\xef\xbb\xbf" + quoted.encode(), "mark open.csv": b"\xef\xbb\xbf" + quoted.encode().rstrip(), "a+b%20.csv": quoted.encode(), "open.csv": quoted.encode() + b'500,"never closed\r',
        "bad.csv": quoted.encode() + b"9,\xe2\x82\n" + quoted.encode(), "end.csv": quoted.encode() + b"9,\xe2\x82", "one": b"x", "feeds": b"\n\n", "cr.csv": b"id,name\r" + b"1,a\r" * 100,
    }
    for name, data in contents.items():
        put(tmp_path, name, data)
    put(tmp_path, "packed.csv.gz", gzip.compress(quoted.encode()))
    put(tmp_path, "packed by mark", gzip.compress(quoted.encode()))
    contents |= {"packed.csv.gz": quoted.encode(), "packed by mark": quoted.encode()}
    splits = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    before = {c: spark.conf.get(c) for c in splits}
    name = lambda p: p.rpartition("/")[2]
    try:
        for c, v in splits.items():
            spark.conf.set(c, v)
        for settings in ({}, {"quote_aware": True}, {"census_bytes": 300}):
            whole = {name(r.path): r for r in raw.file_report(spark, str(tmp_path), **settings).collect()}
            pieces = {name(r.path): r for r in raw.file_report(spark, str(tmp_path), whole=0, size=37, **settings).collect()}
            assert whole == pieces and set(whole) == set(contents)
        whole, pieces = (sorted((tuple(r.fields or ()), str(r.error_code), str(r.message)) for r in delimited.parsed_rows(spark, str(tmp_path), ",", True, 2, **settings).collect()) for settings in ({}, {"whole": 0, "size": 37}))
        assert whole == pieces and len(whole) > 3000
        one = {r._row_id: r.fields for r in delimited.parsed_rows(spark, str(tmp_path / "mark.csv"), ",", True, 2, whole=0, size=37).collect()}
        assert one == {i + 1: [str(i), f"n{i}\nsecond, é line" if i % 3 else "plain"] for i in range(400)}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    reports = {name(r.path): r for r in raw.file_report(spark, str(tmp_path)).collect()}
    for k, data in contents.items():
        r = reports[k]
        assert (r.n_bytes, r.sha256, r.bom) == (len(data), hashlib.sha256(data).hexdigest(), data.startswith(b"\xef\xbb\xbf")), k
        crlf = data.count(b"\r\n")
        assert (r.endings.crlf, r.endings.lf, r.endings.cr) == (crlf, data.count(b"\n") - crlf, data.count(b"\r") - crlf), k
        try:
            data.decode()
            assert r.is_valid, k
        except UnicodeDecodeError as bad:
            assert (r.is_valid, r.offset, r.reason) == (False, bad.start, bad.reason), k


def test_line_ends_outside_quotes_in_any_pieces():
    import random
    import re

    rng = random.Random(3)
    for _ in range(500):
        text = bytes(rng.choice(b'a"\r\n') for _ in range(rng.randrange(30)))
        bare = re.sub(rb'"(?:[^"]|"")*"', b"", text)
        ends, at = raw.LineEndsOutsideQuotes(), 0
        while at < len(text):
            step = rng.randrange(1, 6)
            ends.add(text[at:at + step])
            at += step
        crlf = bare.count(b"\r\n")
        assert ends.end() == (crlf, bare.count(b"\n") - crlf, bare.count(b"\r") - crlf), text
