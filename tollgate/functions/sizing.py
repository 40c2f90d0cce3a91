"""Size-checked broadcast.

A side is broadcast only when a bounded count proves it small; otherwise the
plan is left to a shuffle join (and AQE may still broadcast at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 200_000
#: Session setting with the largest number of rows that is broadcast.
MAX_ROWS_CONF = "tollgate.broadcast.maxRows"


def is_small(df: DataFrame, max_rows: int | None = None, bound: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows (default: the session's
    ``tollgate.broadcast.maxRows``, else 200,000).

    ``bound``: a proven upper bound on the row count (e.g. the size of the
    log it was derived from); when it is small enough no job runs.
    Otherwise the plan of ``df`` runs up to the first ``max_rows + 1`` rows,
    in full where an aggregation stands before them.
    """
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_BROADCAST_ROWS)))
    if bound is not None and bound <= max_rows:
        return True
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, bound: int | None = None) -> DataFrame:
    """``broadcast(df)`` if it ``is_small``, else ``df``."""
    return F.broadcast(df) if is_small(df, max_rows, bound) else df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys``, null keys being equal; ``left``'s keys stay."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, cond, how).drop(*(f"__r_{k}" for k in keys))
