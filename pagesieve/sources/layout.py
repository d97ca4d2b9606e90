"""How text tables are laid out over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a task sorts or groups at a time, on average, and the fewest rows worth a task.
TASK_ROWS, TASK_BYTES, LEAST_ROWS = 100_000, 32 << 20, 1_000
# Above this much input per core the file splits alone keep every core busy.
BALANCED_BYTES_PER_CORE = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimizer expects, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, rows: Column | None = None, text: Column | None = None) -> int:
    """How many tasks ``df`` should be spread over, so that what one holds does not grow with the table.

    Counts the rows, or adds up ``rows`` where one row becomes that many, and the bytes
    of ``text``. Left alone, few splits of small files that make long texts, or partitions
    merged by their compressed size, would each be sorted in one task.
    """
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    size = F.lit(0) if text is None else F.sum(F.octet_length(text).cast("bigint"))
    found = df.agg(F.coalesce(n, F.lit(0)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(min(cores, -(-found.rows // LEAST_ROWS)), -(-found.rows // TASK_ROWS), -(-found.bytes // TASK_BYTES), 1)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread a small table over all cores by a hash of ``keys``.

    A small file is one split and would be one task.  A large table is left
    alone: its splits already outnumber the cores, and a shuffle of the texts
    would cost more than the imbalance.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not keys or estimated_bytes(df) > cores * BALANCED_BYTES_PER_CORE:
        return df
    return df.repartition(cores, *keys)
