"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive plans; other settings go through as they are."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def version() -> dict[str, str]:
    return {"status": "ok", "name": "tallyframe", "version": "0.1.0"}
