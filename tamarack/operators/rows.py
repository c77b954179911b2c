"""Row-level helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: list[str], columns: list[str], newest: str | None = None) -> DataFrame:
    """One row per key: the one with the largest ``newest`` value, ties to the largest content.

    Only ``key`` and ``columns`` are kept, so a scan reads nothing else.  Rows
    are combined before the shuffle; no group is collected.  Null keys form
    one group of their own.
    """
    order = ([newest] if newest else []) + [c for c in columns if c != newest]
    best = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in columns])
