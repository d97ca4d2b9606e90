"""Helpers of the training-data operators: shared tables, texts in batches, word and shingle hashes."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.session import shared_dir

#: Bytes of text that are hashed at a time; bounds the scratch memory of a task.
BLOCK_BYTES = 1 << 20
#: Rows of a side that may be sent to every executor (ids and a few numbers: below 64 MB).
BROADCAST_ROWS = 1_000_000


#: Removes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives executors.

    Spark removes the shuffle files of the write when it ends, not when the driver happens to collect garbage.
    Inside ``released`` it is removed when the block ends, or that around it if it is to ``keep``.
    """
    path = f"{shared_dir(df.sparkSession, name)}/table"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    blocks = getattr(_open, "blocks", [])
    own = blocks[:len(blocks) - keep]
    if own:
        own[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are written inside when the block ends; what is read later must be kept."""
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


Batch = TypeVar("Batch")


def give_back() -> None:
    """Memory that a worker has freed goes back to the system: workers live from task to task, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def tidied(read: Callable[[Iterator[Batch]], Iterator[Batch]]) -> Callable[[Iterator[Batch]], Iterator[Batch]]:
    """``read``, the work of a task, and ``give_back`` at its end."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        try:
            yield from read(batches)
        finally:
            give_back()

    return run


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written side for broadcast if its row count is within the bound; beyond it Spark shuffles the join."""
    return F.broadcast(df) if df.count() <= rows else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows of ``df``, written in the given order, with ``at``: their place in it, from 0.

    Spark sorts by ranges, so no task holds more than one of them; only a count for
    each range comes to the driver. ``order`` should tell all rows apart, else equal
    ones fall into one range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(ranged, name)
    counts = sorted(rows.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total - (part << 33)))
        total += count
    moved = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    placed = rows.join(moved, F.shiftright("at", 33) == F.col("_part"))
    return placed.withColumn("at", F.col("at") + F.col("_start")).drop("_part", "_start")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3 * 0x1B8735 + 2 & 0xFFFFFFFFFFFFFFFF | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _powers(n: int, cache: dict[str, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """Powers of the base; those of words of usual length are kept."""
    if n > 4096:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]), dtype=np.uint64)
    if "powers" not in cache:
        cache["powers"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _BASE)]), dtype=np.uint64)
    return cache["powers"]


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are no ASCII white space."""
    inside = np.empty(len(buffer) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[buffer], out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(total) - np.repeat(first, lengths)
    values = _BYTE[buffer[np.repeat(starts, lengths) + place]] * _powers(int(lengths.max()))[place]
    return _mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _GOLDEN)


def _cut(data: bytes) -> Iterator[bytes]:
    """A text in parts of about a block, cut at white space."""
    start = 0
    while len(data) - start > 2 * BLOCK_BYTES:
        end = start + BLOCK_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def _hash_words(data: bytes) -> np.ndarray:
    buffer = np.frombuffer(data, np.uint8)
    return hash_spans(buffer, *word_spans(buffer))


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, hashes of the words) of every text; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    block: list[bytes] = []
    size = first = 0
    at = -1

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        buffer = np.frombuffer(b"\n".join(block), np.uint8)
        starts, ends = word_spans(buffer)
        hashes = hash_spans(buffer, starts, ends)
        offsets = np.cumsum([0, *(len(x) + 1 for x in block)])
        bounds = np.searchsorted(starts, offsets)
        for i in range(len(block)):
            yield first + i, hashes[bounds[i]:bounds[i + 1]]

    for at, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if len(data) > BLOCK_BYTES:
            yield from flush()
            yield at, np.concatenate([_hash_words(part) for part in _cut(data)])
            block, size, first = [], 0, at + 1
            continue
        block.append(data)
        size += len(data)
        if size > BLOCK_BYTES:
            yield from flush()
            block, size, first = [], 0, at + 1
    yield from flush()


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words in order; fewer words make one shingle, none makes none."""
    k = min(k, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i:i + n]
    return _mix(out + np.uint64(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


