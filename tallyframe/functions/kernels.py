"""Scalar kernels: columns of strings to columns, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols that break a money or number format, and the patterns of the formats.
SYMBOLS = "$,()"
NUMERIC = r"^[0-9]+(\.[0-9]+)?$"
MONEY = r"^[0-9]+\.[0-9]{2}$"
ALPHA = r"^[a-zA-Z]+$"
#: Date formats in order of preference, with their shape and parser pattern.
INFERRED_DATES = [
    ("YYYYMMDD", r"^[0-9]{8}$", "yyyyMMdd"),
    ("YYYY-MM-DD", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    ("YYYY/MM/DD", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    ("MM/DD/YYYY", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"),
    ("MM-DD-YYYY", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "MM-dd-yyyy"),
]
CHECKED_DATES = [*INFERRED_DATES, ("YYYY-MM-DD HH:MM:SS", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss")]
DAY_FIRST = ("DD/MM/YYYY", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy")
DELIMITER_NAMES = {",": "Comma", "|": "Pipe", "\t": "Tab", ";": "Semicolon"}


def strip(v: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+\z", "")


def is_blank(v: Column) -> Column:
    return v.isNull() | (strip(v) == "")


def is_numeric(v: Column) -> Column:
    return v.rlike(NUMERIC)


def is_money(v: Column) -> Column:
    return v.rlike(MONEY)


def is_alpha(v: Column) -> Column:
    return v.rlike(ALPHA)


def has_symbol(v: Column) -> Column:
    return v.rlike(r"[$,()]")


def cleaned(v: Column) -> Column:
    return strip(F.translate(v, SYMBOLS, ""))


def numeric_like(v: Column) -> Column:
    """A number once its symbols are gone."""
    return is_numeric(cleaned(v))


def money_like(v: Column) -> Column:
    """It has a symbol, and without symbols it is a number with a decimal point."""
    return has_symbol(v) & is_numeric(cleaned(v)) & cleaned(v).contains(".")


def wrong_decimals(v: Column) -> Column:
    """A number whose fraction has neither no nor two digits."""
    return v.rlike(r"^[0-9]+\.([0-9]|[0-9]{3,})$")


def breaks_money(v: Column) -> Column:
    return has_symbol(v) | ~is_money(v)


def parse_date(v: Column, fmt: Column, formats=None) -> Column:
    """The date of ``v`` in the format named by ``fmt``; null where it isn't one."""
    formats = formats or [*CHECKED_DATES, DAY_FIRST]
    return F.coalesce(*(F.when((fmt == name) & v.rlike(shape), F.to_date(F.try_to_timestamp(v, F.lit(pattern)))) for name, shape, pattern in formats))


def date_format(v: Column, formats=None) -> Column:
    """The first format, in order of preference, in which ``v`` is a date of the calendar."""
    return F.coalesce(*(F.when(v.rlike(shape) & F.try_to_timestamp(v, F.lit(pattern)).isNotNull(), F.lit(name)) for name, shape, pattern in formats or INFERRED_DATES))


def value_class(v: Column) -> Column:
    """date, money, numeric, alpha or none: the first that holds. Look-alikes with symbols count."""
    return (
        F.when(date_format(v).isNotNull(), "date")
        .when(is_money(v) | money_like(v), "money")
        .when(is_numeric(v) | numeric_like(v), "numeric")
        .when(is_alpha(v), "alpha")
        .otherwise("none")
    )


#: Character classes by pattern; what is in none of them (emoji) adds nothing.
CHARACTER_CLASSES = {
    "alpha": r"\p{L}",
    "digit": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]",
    "space": r"(?U)\s",
    "special": r"[!-/:-@\[-`{-~]",
}


def non_ascii(v: Column) -> Column:
    return v.rlike(r"[^\x00-\x7F]")


def money_verdict(v: Column) -> Column:
    """Why a value is no money, or "ok"; white space makes it invalid."""
    return (
        F.when(is_money(v), "ok")
        .when(v.contains("$"), "dollar sign not allowed")
        .when(v.contains(","), "comma not allowed")
        .when(v.rlike(r"[()]"), "parentheses not allowed")
        .when(~v.contains("."), "missing decimal point")
        .when(is_numeric(v), "needs exactly two decimals")
        .otherwise("invalid money format")
    )


def float_text(x: Column) -> Column:
    """A double (or float) as Python and SQL show it: plain from 1e-4 up to 1e16, else as 5.6e-05, where
    the JVM writes 5.6E-5 and 1.0E7. A value of another type is its plain text. The digits are the JVM's:
    before Java 19 it may give one more than needed from 1e16 on, and to denormal numbers."""
    text = x.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(\.0)?E", "e"), r"e(\d)", r"e+$1"), r"e([+-])(\d)$", r"e$10$2")
    shown = F.when(text.rlike(r"E(-4|\d|1[0-5])$"), plain).otherwise(power)
    special = F.regexp_replace(F.lower(text), "inity", "")
    float_like = F.typeof(x).isin("double", "float")  # constant, so that other types keep their text
    return F.when(float_like & text.contains("E"), shown).when(float_like & (text.endswith("N") | text.endswith("y")), special).otherwise(text)


def guard_formula(v: Column) -> Column:
    """A leading = + - or @ gets an apostrophe, so that a spreadsheet reads text; null is empty."""
    text = F.coalesce(float_text(v), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def finite(v: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def finite_map(v: Column) -> Column:
    return F.transform_values(v, lambda _, x: finite(x))


def show_number(v: Column) -> Column:
    """1e6 and up without decimals, 1 and up with two, else with four; thousands are grouped."""
    return F.when(F.abs(v) >= 1e6, F.format_number(v, 0)).when(F.abs(v) >= 1, F.format_number(v, 2)).otherwise(F.format_number(v, 4))


def delimiter_name(v: Column) -> Column:
    return reduce(lambda out, item: out.when(v == item[0], item[1]), DELIMITER_NAMES.items(), F.when(F.lit(False), "")).otherwise(v)


def example_row(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
