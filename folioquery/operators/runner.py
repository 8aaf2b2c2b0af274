"""A chain of stages that stops at the first one that fails."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

OUTCOME = "stage string, status string, error string"


def run_chain(spark: SparkSession, stages: Sequence[tuple[str, Callable[[], object]]]) -> DataFrame:
    """Run the stages in order: one row each, ``done``, ``failed`` with its error, or ``not run``."""
    rows, failed = [], False
    for name, run in stages:
        if failed:
            rows.append((name, "not run", None))
            continue
        try:
            run()
            rows.append((name, "done", None))
        except Exception as e:  # noqa: BLE001 - the outcome is the report of the failure
            failed = True
            rows.append((name, "failed", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, OUTCOME)
