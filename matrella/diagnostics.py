"""What a plan does, what an object holds, which versions run, and how much is logged."""

from __future__ import annotations

import contextlib
import io
import logging
import platform
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("matrella")


def set_log_level(level: str, spark: SparkSession | None = None) -> None:
    """The engine's own level and Spark's: debug, info, warning or error."""
    log.setLevel(level.upper())
    got = spark or SparkSession.getActiveSession()
    if got is not None:
        got.sparkContext.setLogLevel({"WARNING": "WARN"}.get(level.upper(), level.upper()))


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def versions() -> dict[str, str]:
    return {"pyspark": pyspark.__version__, "pyarrow": pa.__version__, "pandas": pd.__version__, "numpy": np.__version__, "python": platform.python_version()}


def object_stats(obj: object) -> dict[str, object]:
    """What the log says of a stored object: fragments, rows as written, deletes, events."""
    s = obj.state
    return {"kind": s.kind, "fragments": len(s.fragments), "rows_written": sum(f["rows"] for f in s.fragments), "deletes": len(s.deletes), "events": len(obj.log.events()), "columns": len(s.schema)}


@contextlib.contextmanager
def timed(what: str) -> Iterator[dict[str, float]]:
    """Logs how long a block took; the seconds are in what it gives."""
    got: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield got
    finally:
        got["seconds"] = time.perf_counter() - began
        log.info("%s: %.3f s", what, got["seconds"])


class Eta:
    """Time left by linear regression of work done on time, from the last measurements."""

    def __init__(self, keep: int = 100):
        self.keep, self.seen = keep, []

    def add(self, done: float, at: float | None = None) -> None:
        self.seen = [*self.seen, (time.monotonic() if at is None else at, done)][-self.keep :]

    def left(self, total: float) -> float | None:
        """Seconds from the last measurement on; None while nothing can be told."""
        if len(self.seen) < 2:
            return None
        t, done = np.array(self.seen).T
        rate = np.polyfit(t - t[0], done, 1)[0] if np.ptp(t) > 0 else 0.0
        return max(0.0, (total - done[-1]) / rate) if rate > 0 else None
