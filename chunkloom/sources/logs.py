"""Log tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_tail(lines: DataFrame, order: str, text: str, n: int = 10) -> DataFrame:
    """The last ``n`` lines by ``order`` that contain ``error`` in any letter case, trimmed."""
    return lines.select(order, F.trim(text).alias(text)).where(F.contains(F.lower(text), F.lit("error"))).orderBy(F.desc(order)).limit(n)
