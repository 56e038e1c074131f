"""Settings of a profile, with the thresholds of type inference and key scoring."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Fixed values, needed for equal results."""

    sample_size: int = 100
    dominant: float = 0.66
    present: float = 0.20
    code_ratio: float = 0.50
    code_distinct: int = 50
    code_distinct_least: int = 50
    code_least: int = 6
    first_year: int = 1900
    examples: int = 3
    top_values: int = 10
    key_score: float = 0.5
    key_distinct_ratio: float = 0.5
    strict_key_score: float = 0.9
    strict_key_pct: float = 95.0
    compound_distinct_ratio: float = 0.7
    compound_null_ratio: float = 0.10
    compound_accept: float = 0.995
    keys: int = 5


@dataclass(frozen=True)
class ProfileConfig:
    """How to read a file. A null delimiter or quoting means: detect."""

    delimiter: str | None = None
    quoted: bool | None = None
    has_header: bool = True
    continue_on_error: bool = True
    expect_crlf: bool = False
    null_tokens: tuple[str, ...] = ()
    #: Types that a user expects, by column: kept with the settings, never read by inference.
    type_hints: dict[str, str] = field(default_factory=dict)
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        if self.delimiter not in (None, "|", ",", "\t", ";"):
            raise ValueError("the delimiter must be one of | , tab ;")
