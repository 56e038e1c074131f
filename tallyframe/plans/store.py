"""Runs and their states: one small JSON file a run, and a table view of all."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["queued", "processing", "completed", "failed"]
RUN = "run_id string, created double, state string, progress int, source string, errors array<struct<code: string, message: string, count: long>>, warnings array<struct<code: string, message: string, count: long>>"


class RunStore:
    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, run_id: str) -> str:
        if os.path.basename(run_id) != run_id:
            raise ValueError("not a run id")
        return f"{self.folder}/{run_id}/run.json"

    def create(self, source: str = "") -> str:
        run_id = str(uuid.uuid4())
        os.makedirs(f"{self.folder}/{run_id}")
        self.save({"run_id": run_id, "created": time.time(), "state": "queued", "progress": 0, "source": source, "errors": [], "warnings": []})
        return run_id

    def load(self, run_id: str) -> dict:
        with open(self._path(run_id), encoding="utf-8") as f:
            return json.load(f)

    def save(self, run: dict) -> None:
        path = self._path(run["run_id"])
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(run, f)
        os.replace(f"{path}.new", path)

    def move(self, run_id: str, state: str, progress: int | None = None) -> None:
        """To a later state; a finished run doesn't move."""
        run = self.load(run_id)
        if run["state"] in STATES[2:] or STATES.index(state) < STATES.index(run["state"]):
            raise ValueError(f"a run can't go from {run['state']} to {state}")
        self.save(run | {"state": state, "progress": run["progress"] if progress is None else progress})

    def add(self, run_id: str, code: str, message: str, count: int = 1) -> None:
        """An error or warning; counts of equal codes add up."""
        run = self.load(run_id)
        kind = run["warnings" if code.startswith("W_") else "errors"]
        for x in kind:
            if x["code"] == code:
                x["count"] += count
                break
        else:
            kind.append({"code": code, "message": message, "count": count})
        self.save(run)

    def runs(self) -> list[dict]:
        return [self.load(x) for x in os.listdir(self.folder) if os.path.exists(self._path(x))]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([[r[c.split(" ")[0]] for c in ("run_id", "created", "state", "progress", "source", "errors", "warnings")] for r in self.runs()], RUN)

    def newest(self, spark: SparkSession, limit: int = 20) -> DataFrame:
        return self.table(spark).orderBy(F.desc("created")).limit(max(0, min(limit, 100)))

    def cleanup(self, keep: int = 10) -> list[str]:
        """Delete all but the newest runs; returns what went."""
        old = [r["run_id"] for r in sorted(self.runs(), key=lambda r: r["created"], reverse=True)[keep:]]
        for run_id in old:
            shutil.rmtree(f"{self.folder}/{run_id}")
        return old
