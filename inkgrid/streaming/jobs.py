"""Latest-wins requests: of each session's jobs in a micro-batch only the newest is rendered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame, session: str = "session", order: list[str] | None = None) -> DataFrame:
    """One row a session: the last by order; a partial aggregate, so a busy session is no hot task."""
    order = order or ["ts", "seq"]
    rest = [c for c in jobs.columns if c not in (session, *order)]
    return jobs.groupBy(session).agg(F.max(F.struct(*order, *rest)).alias("_j")).select(session, *(F.col("_j")[c].alias(c) for c in [*order, *rest]))


def start(jobs: DataFrame, render: Callable[[DataFrame, int], None], checkpoint: str, session: str = "session", order: list[str] | None = None, trigger: dict | None = None):
    """A query over a stream of jobs; render gets the newest job of each session and the batch's number."""
    return jobs.writeStream.foreachBatch(lambda df, n: render(latest(df, session, order), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
