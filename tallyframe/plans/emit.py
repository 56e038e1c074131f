"""Results as JSON, CSV, HTML and an audit log. A profile has a row a column, so this runs on the driver."""

from __future__ import annotations

import html
import json
import math
import os
import time
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import guard_formula
from .profile import Profile

#: The columns of metrics.csv and the kinds of audit events.
METRICS = ["column_name", "type", "null_count", "distinct_count", "distinct_pct", "min_value", "max_value", "mean", "median", "stddev", "min_length", "max_length", "avg_length", "top_value_1", "top_value_1_count", "top_value_2", "top_value_2_count", "top_value_3", "top_value_3_count"]
EVENTS = ["run_created", "file_uploaded", "validation_started", "validation_completed", "parsing_started", "parsing_completed", "type_inference_started", "type_inference_completed", "profiling_started", "profiling_completed", "run_completed", "run_failed", "error_recorded", "warning_recorded"]


def clean(value):
    """NaN and infinities as null, at any depth."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    return [clean(x) for x in value] if isinstance(value, (list, tuple)) else value


def profile_dict(profile: Profile) -> dict:
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    totals = plain(profile.totals)[0]
    return clean({"run_id": profile.run_id, "state": profile.state, "file": profile.dialect, **totals, "columns": plain(profile.columns), "candidate_keys": plain(profile.candidate_keys), "errors": plain(profile.errors)})


def write_json(profile: Profile, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(profile_dict(profile), out, ensure_ascii=False, indent=1, default=str)


def metrics(columns: DataFrame) -> DataFrame:
    """The 19 columns of metrics.csv, guarded against formulas."""
    top = lambda i, part: F.try_element_at("top_values", F.lit(i))[part]
    chosen = [F.col("name"), F.col("type"), *(F.col(c) for c in ("null_count", "distinct_count", "distinct_pct", "min", "max", "mean", "median", "stddev", "min_length", "max_length", "avg_length"))]
    chosen += [top(i, part) for i in (1, 2, 3) for part in ("value", "count")]
    return columns.select(*(guard_formula(c).alias(name) for c, name in zip(chosen, METRICS)))


def metrics_small(columns: DataFrame) -> DataFrame:
    """The variant of five columns."""
    return metrics(columns).select("column_name", "type", "null_count", "distinct_count", "distinct_pct")


def write_metrics(profile: Profile, path: str) -> None:
    """One CSV file on any store, through Spark: a row a column."""
    metrics(profile.columns).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


PAGE = Template("""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Profile</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.card{display:inline-block;border:1px solid #ccc;padding:1em;margin:.3em}</style></head>
<body><h1>Profile $run</h1><div>$cards</div><h2>Errors</h2>$errors<h2>Columns</h2>$columns<h2>Candidate keys</h2>$keys</body></html>""")


def shown(value) -> str:
    if isinstance(value, float):
        return f"{value:,.0f}" if abs(value) >= 1e6 else f"{value:,.2f}" if abs(value) >= 1 else f"{value:.4f}"
    if isinstance(value, list):
        return ", ".join(f"{x['value']} ({x['count']})" if isinstance(x, dict) and "value" in x else str(x) for x in value)
    return "" if value is None else str(value)


def _table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(shown(x))}</{tag}>"
    return "<table><tr>" + "".join(cell("th", c) for c in columns) + "</tr>" + "".join("<tr>" + "".join(cell("td", r.get(c)) for c in columns) + "</tr>" for r in rows) + "</table>" if rows else "<p>None</p>"


def html_report(profile: Profile) -> str:
    """Summary, errors, metrics of each column with its top values, and keys; everything is escaped."""
    d = profile_dict(profile)
    cards = "".join(f'<div class="card"><b>{html.escape(shown(d[k]))}</b><br>{k.replace("_", " ")}</div>' for k in ("total_rows", "total_columns", "total_nulls", "total_distinct"))
    return PAGE.substitute(run=html.escape(d["run_id"]), cards=cards, errors=_table(d["errors"], ["code", "message", "count", "is_catastrophic"]), columns=_table(d["columns"], ["name", "type", "null_count", "null_pct", "distinct_count", "distinct_pct", "min", "max", "mean", "median", "stddev", "min_length", "max_length", "min_date", "max_date", "top_values"]), keys=_table(d["candidate_keys"], ["columns", "distinct_ratio", "null_ratio_sum", "score", "explanation"]))


class AuditLog:
    """JSON lines: kinds of events, counts and hashes, never values of the data."""

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id = path, run_id

    def log(self, event: str, **details) -> None:
        if event not in EVENTS:
            raise ValueError(f"no such event: {event}")
        if bad := [k for k, v in details.items() if not isinstance(v, (int, float, bool, str, type(None)))]:
            raise ValueError(f"only counts, hashes and names are logged, not {', '.join(bad)}")
        with open(self.path, "a", encoding="utf-8") as out:
            out.write(json.dumps({"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "event": event, "run_id": self.run_id, "details": details}) + "\n")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_artifacts(profile: Profile, folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    log = AuditLog(f"{folder}/audit.jsonl", profile.run_id)
    write_json(profile, f"{folder}/profile.json")
    write_metrics(profile, f"file://{os.path.abspath(folder)}/metrics.csv")
    with open(f"{folder}/report.html", "w", encoding="utf-8") as out:
        out.write(html_report(profile))
    log.log("run_completed", **{k: v for k, v in profile.totals.first().asDict().items()})
