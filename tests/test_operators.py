import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyframe.functions import kernels as k
from tallyframe.operators import dates, distinct, errors, infer, keys, longform, money, numeric, strings


def cells(spark, **columns):
    n = max(map(len, columns.values()))
    rows = [(i + 1, *(v[i] if i < len(v) else None for v in columns.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"`{c}` string" for c in columns))
    long = longform.to_long(df)
    return df, long, longform.frequencies(long)


def by_col(df):
    return {r["col"]: r for r in df.collect()}


TYPES = {
    "numeric": ["1", "22", "3.5", "4", "5", "6", "7"],
    "money": ["1.00", "2.50", "$3.00", "4.10", "5.25", "6.00", "7.00"],
    "date": ["20240101", "2024-01-02", "20240103", "20240104", "20240105", "20241399", "20240107"],
    "alpha": ["a", "b", "c", "d", "e", "f", "g"],
    "code": ["a", "b", "a", "b", "a", "b", "a"],
    "varchar": ["a 1", "b 2", "c 3", "d 4", "e 5", "f 6", "g 7"],
    "mixed": ["1", "2", "x", "y", "z", "20240101", "20240102"],
    "unknown": ["", " ", None, "", "", "", ""],
    "hole": ["1", "2", "3", "A-1", "A-2", "A-3", "A-4"],
}


def test_every_type_outcome(spark):
    _, long, freq = cells(spark, **TYPES)
    got = by_col(infer.infer_types(long, freq))
    assert {c: r.type for c, r in got.items()} == {c: (None if c == "hole" else c) for c in TYPES}
    assert got["money"].error_count == 1
    assert (got["date"].detected_format, got["date"].warning_count) == ("YYYYMMDD", 1)
    assert got["unknown"].null_count == 7


def test_leaderless_mixed_has_no_errors_and_money_with_numbers_has(spark):
    price = ["123.45", "0.00", "999999.99", "1234567.89", "45.67", "$5.00", "1,000.00", "(9.99)", "1", "2", "3.5", "4", "5.123", "n/a", "x-1"]
    other = ["10.00", "20.00", "$30.00", "1", "2", "3", "4.00", "5", "6.00", "7.00"]
    _, long, freq = cells(spark, a=price, b=other)
    got = by_col(infer.infer_types(long, freq))
    assert (got["a"].type, got["a"].error_count) == ("mixed", 0)
    assert got["b"].type == "mixed"
    codes = {r.code: r["count"] for r in errors.rollup(infer.format_errors(infer.infer_types(long, freq)), 15).collect()}
    assert "E_MIXED_FORMAT" in codes or got["b"].error_count == 0


def test_distinct_null_rules(spark):
    _, _, freq = cells(spark, a=["x", " x", "", None, '""', "  ", "X"])
    r = distinct.distinct_counts(freq).first()
    assert (r.total_count, r.null_count, r.empty_count, r.distinct_count) == (7, 2, 1, 3)
    assert distinct.distinct_counts(freq, case_sensitive=False).first().distinct_count == 2
    assert distinct.distinct_counts(freq, trim=False).first().distinct_count == 4


def test_moments_histogram_and_normality(spark):
    _, long, freq = cells(spark, one=["5"], same=["7"] * 9, bad=["x", "-1", "1e3", ".5", "5."], v=[str(x) for x in range(1, 12)])
    got = by_col(numeric.numeric_profile(long))
    assert got["one"].stddev is None and got["one"]["mean"] == 5
    assert got["same"].gaussian_pvalue is None and got["same"].stddev == 0
    assert (got["bad"].valid_count, got["bad"].invalid_count) == (0, 5)
    assert got["v"].quantiles["p25"] == 3.5 and 0 < got["v"].gaussian_pvalue < 1
    bins = {(r["col"], r.bin): r.cnt for r in numeric.histogram(freq).collect()}
    assert bins["same", "7.0"] == 9 and bins["v", "10.00-11.00"] == 2
    exact = {(r["col"], r.name): r.quantile for r in numeric.exact_quantiles(freq).collect()}
    assert exact["v", "p25"] == 3.5 and exact["one", "p99"] == 5 and exact["same", "p1"] == 7


def test_money_labels(spark):
    _, long, freq = cells(spark, a=["1.00", "-5.00", "$1.00", "1,000.5", "(2.00)", "12", " 3.00 ", None])
    r = money.money_profile(freq).first()
    assert (r.valid_count, r.invalid_count, r.null_count) == (2, 5, 1)
    assert r.violations == {"dollar_sign": 1, "comma": 1, "parentheses": 1, "wrong_decimals": 2}
    assert (r.min_value, r.max_value) == (1.0, 3.0)
    kinds = {(x.kind, x.example) for x in money.violation_examples(long).collect()}
    assert ("wrong_decimals", "1,000.5") in kinds and ("wrong_decimals", "12") not in kinds


def test_day_first_votes_end_with_the_first_month_first_cell(spark):
    _, long, freq = cells(spark, a=["13/02/2024", "14/02/2024", "03/04/2024", "25/12/2024"], b=["20240101", "18990101", "20240230", "x"])
    got = {(r["col"], r.fmt): r.cnt for r in dates.format_votes(long).collect()}
    assert got["a", "DD/MM/YYYY"] == 2 and got["a", "MM/DD/YYYY"] == 1
    b = by_col(dates.date_profile(long, freq, 1900, 2030))["b"]
    assert (b.valid_count, b.invalid_count, b.out_of_range_count, b.min_date) == (2, 2, 1, "18990101")
    assert dates.range_warnings(long, freq, 1900, 2030).where("col = 'b'").count() == 1


def test_strings_and_emoji(spark):
    _, _, freq = cells(spark, a=["😀a", "b²", " c\t", "É!"], b=[None, "", " ", None])
    got = by_col(strings.string_profile(freq))
    assert (got["a"].max_length, got["a"].has_non_ascii) == (2, True)
    assert got["a"].character_types == ["alpha", "digit", "special"]
    assert got["b"].min_length is None and got["b"].null_count == 4


def test_top_values_ties_by_first_row(spark):
    _, _, freq = cells(spark, a=["z", "y", "y", "z", "x"])
    assert [r.value for r in longform.top_values(freq, 2).orderBy("rank").collect()] == ["z", "y"]


def test_duplicates_and_keys(spark):
    df, _, freq = cells(spark, id=["1", "1", "2", "", "3"], mail=["a|b", "A|b", "c", "d", "e"], x=["1", "2", "3", "4", "5"])
    r = keys.duplicate_summary(df, ["id"]).first()
    assert (r.duplicate_count, r.duplicate_rows, r.surplus_rows, r.null_key_count, r.duplicate_pct) == (1, 2, 1, 1, 20.0)
    assert keys.duplicate_summary(df, ["id", "mail"]).first().duplicate_count == 0
    assert keys.duplicate_summary(df, ["id", "mail"], case_sensitive=False).first().duplicate_count == 1
    top = keys.top_duplicates(df, ["id"]).collect()
    assert [(t.key_value, t.n, t.row_numbers) for t in top] == [("1", 2, [1, 2])]
    with pytest.raises(ValueError, match="nope"):
        keys.duplicate_groups(df, ["nope"])
    counts = distinct.distinct_counts(freq)
    assert keys.suggest_keys(counts).first()["columns"] == ["mail"]
    pairs = keys.compound_stats(df, counts)
    assert {tuple(p["columns"]) for p in pairs.collect()} >= {("mail", "x")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "_row_id long, a string")
    long = longform.to_long(df)
    freq = longform.frequencies(long)
    for out in (infer.infer_types(long, freq), numeric.numeric_profile(long), numeric.histogram(freq), strings.string_profile(freq), money.money_profile(freq), dates.date_profile(long, freq), distinct.distinct_counts(freq), keys.duplicate_groups(df, ["a"])):
        assert out.count() == 0
    assert keys.duplicate_summary(df, ["a"]).first().total_rows == 0


def test_scalars(spark):
    df = spark.createDataFrame([("=1", "$1,2.50", 1234567.8), (None, "x", 0.5), ("a", " ", float("nan"))], "a string, b string, c double")
    got = df.select(k.guard_formula(F.col("a")).alias("g"), k.money_like(F.col("b")).alias("m"), k.show_number(F.col("c")).alias("s"), k.finite(F.col("c")).alias("f"), k.is_blank(F.col("b")).alias("bl"), k.delimiter_name(F.lit("|")).alias("d"), k.example_row("a", "b").alias("e")).collect()
    assert [r.g for r in got] == ["'=1", "", "a"]
    assert got[0].m and not got[1].m and got[2].bl and got[0].d == "Pipe"
    assert (got[0].s, got[1].s, got[2].f) == ("1,234,568", "0.5000", None)
    assert got[0].e == '{"a":"=1","b":"$1,2.50"}'


def test_error_rollup_and_samples(spark):
    e = spark.createDataFrame([("E_X", "m", 3, "a"), ("E_X", "first", 1, "a"), ("E_JAGGED_ROW", None, 2, None)], "code string, message string, line long, column string")
    got = errors.rollup(e, 10).collect()
    assert (got[0].code, got[0]["count"], got[0].first_line, got[0].message, got[0].percentage) == ("E_X", 2, 1, "first", 20.0)
    assert got[1].is_catastrophic and got[1].message == "Inconsistent column count detected"
    assert errors.sampled(e, 1).count() == 2
    assert errors.friendly("E_UTF8_INVALID").startswith("The file has bytes")
    assert errors.friendly("E_JAGGED_ROW", "row 7").endswith("(row 7)") and errors.friendly("E_NEW", "as it is") == "as it is"


@pytest.mark.parametrize("rows", [[(i, str(i)) for i in range(300)], [(i << 33, f" {i} ") for i in range(150)] + [(i, "  " if i % 2 else None) for i in range(1, 3000)], [(-i, f"n{i}") for i in range(400)], [(7, "one")], []])
def test_first_values_in_row_order(spark, rows):
    df = spark.createDataFrame(rows, "_row_id long, v string").withColumn("w", F.lit(None).cast("string")).repartition(3)
    got = longform.first_values(longform.to_long(df), 100).orderBy("_row_id").collect()
    want = sorted((i, v.strip()) for i, v in rows if v and v.strip())[:100]
    assert [(r._row_id, r.value) for r in got] == want


def test_quantiles_without_frequencies(spark):
    rng = random.Random(3)
    values = [round(rng.lognormvariate(0, 3), 3) for _ in range(3000)] + [1.5] * 1500
    df = spark.createDataFrame([(i, repr(v), str(i % 3)) for i, v in enumerate(values)], "_row_id long, v string, w string")
    got = {r.col: r.quantiles for r in numeric.numeric_profile(longform.to_long(df)).collect()}
    for name, p in numeric.QUANTILES.items():
        assert got["v"][name] == pytest.approx(np.quantile(values, p), rel=1e-9)
        assert got["w"][name] == pytest.approx(np.quantile([i % 3 for i in range(4500)], p))


def test_unexpected_failures_have_codes(spark, tmp_path):
    from tallyframe.plans import profile

    with pytest.raises(profile.RunFailed) as failed:
        profile.profile_file(spark, str(tmp_path / "not there"))
    assert failed.value.code == "E_PROCESSING_FAILED"
    with pytest.raises(profile.RunFailed) as failed, profile.failing("E_PIPELINE_FAILED"):
        raise KeyError("x")
    assert failed.value.code == "E_PIPELINE_FAILED"


def test_compound_keys_agree_with_counting_every_combination(spark):
    from itertools import combinations

    rng = random.Random(7)
    hole = lambda x, share: None if rng.random() < share else x
    rows = [(i, str(i), hole(f"u{i}", 0.05), hole(f"v{rng.randrange(900)}", 0.06), hole(rng.choice(["", f"w{rng.randrange(1200)}"]) if i % 20 == 0 else f"w{i % 380}", 0.02), f"x{i % 390}", str(i % 3)) for i in range(400)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"{c} string" for c in names))
    counts = distinct.distinct_counts(longform.frequencies(longform.to_long(df)))
    gated = [r.col for r in counts.orderBy("ordinal").collect() if r.distinct_count / 400 > 0.7 and r.null_count / 400 < 0.1]
    assert len(gated) >= 4
    want = {}
    for size in (2, 3):
        for combo in combinations(gated, size):
            at = [names.index(c) + 1 for c in combo]
            kept = [tuple(r[i] for i in at) for r in rows if all(r[i] for i in at)]
            want[combo] = (len(set(kept)) / 400, 400 - len(kept), len(kept) - len(set(kept)))
    got = {tuple(r.columns): (r.distinct_ratio, r.invalid_count, r.estimated_duplicates) for r in keys.compound_stats(df, counts).collect()}
    assert got == want
    assert keys.compound_stats(df.limit(0), distinct.distinct_counts(longform.frequencies(longform.to_long(df.limit(0))))).count() == 0
