"""Probes of the services that an application needs, as rows for plans.ask.health."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Status of a cluster that names its state by a colour.
COLOURS = {"green": "ok", "yellow": "degraded"}


def colour_status(colour: str | None) -> str:
    return COLOURS.get((colour or "").lower(), "error")


def model_status(listed: list[str], wanted: str) -> str:
    """ok if a model service lists the model (its tag aside), else degraded."""
    return "ok" if any(name == wanted or name.split(":")[0] == wanted.split(":")[0] for name in listed) else "degraded"


def probe(spark: SparkSession, checks: dict[str, Callable[[], str]], clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """service, status, latency_ms, detail: each check returns a status; one that raises is an error."""
    rows = []
    for name, check in checks.items():
        began = clock()
        try:
            status, detail = check(), None
        except Exception as e:  # whatever a service's client raises is its status
            status, detail = "error", str(e)
        rows.append((name, status, round((clock() - began) * 1000.0, 3), detail))
    return spark.createDataFrame(rows, "service string, status string, latency_ms double, detail string")
