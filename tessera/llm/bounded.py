"""Broadcasts behind a check of their size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored, stored_bytes

#: A side is broadcast up to so many bytes as Parquet, whatever its rows.
MAX_BYTES = 32 << 20


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` computed once, marked for broadcast if it has at most ``max_rows`` rows and ``MAX_BYTES``.

    A larger one is left to the planner, which then shuffles both sides of the join.
    """
    path = f"{shared_dir(df.sparkSession)}/side-{uuid.uuid4().hex}"
    df = stored(df, path)
    small = stored_bytes(df.sparkSession, path) <= MAX_BYTES and df.count() <= max_rows
    return F.broadcast(df) if small else df
