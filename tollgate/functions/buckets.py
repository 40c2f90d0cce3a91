"""Time-bucket partitioning with edge copies, in one pass.

Windows over (key, time bucket) instead of key alone keep a hot key from
landing in one task.  A row within ``span`` of its bucket's end is also
needed as context by the next bucket: it is emitted twice by one
``explode`` (no self-union, so nothing upstream is computed twice).  The
copy keeps only the columns the window needs; the rest are nulled so they
do not travel through the shuffle twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bucket_copies(
    df: DataFrame,
    t_col: str,
    width_us: int,
    span_us: int,
    keep: list[str],
    copy_when: Column | None = None,
    forward: bool = True,
) -> DataFrame:
    """Add ``__bk`` and ``__own``.  ``forward``: rows near a bucket's end are
    copied into the next bucket; otherwise rows near a bucket's start are
    copied into the previous one.  ``copy_when`` limits which rows copy."""
    bk = F.floor(F.col(t_col) / width_us)
    if forward:
        near = F.col(t_col) >= (bk + 1) * width_us - span_us
        shift = 1
    else:
        near = F.col(t_col) < bk * width_us + span_us
        shift = -1
    if copy_when is not None:
        near = near & copy_when
    copies = F.when(near, F.array(F.lit(0), F.lit(shift))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("__shift", F.explode(copies))
    out = out.withColumn("__bk", bk + F.col("__shift")).withColumn("__own", F.col("__shift") == 0)
    keep_set = set(keep) | {t_col, "__bk", "__own"}
    nulled = {c: F.when(F.col("__own"), F.col(c)) for c in df.columns if c not in keep_set}
    return out.withColumns(nulled).drop("__shift") if nulled else out.drop("__shift")
