"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window that occurs
more than once keeps its first occurrence (smallest doc_id, then position); the
lines of all later occurrences, overlapping ones merged, are removed. A line is
only removed where an earlier copy of it exists, so no line is lost everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import free_name, materialize, tidied

WINDOW_LINES = 3


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, text_id, window, pos): a 128-bit hash of each window that isn't blank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes, places = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (text or "").split("\n")
                if len(parts) < lines:
                    continue
                key = hashlib.md5(text.encode()).digest()
                blank = [not part.strip() for part in parts]
                for i in range(len(parts) - lines + 1):
                    if all(blank[i:i + lines]):
                        continue
                    ids.append(doc_id)
                    texts.append(key)
                    hashes.append(xxhash.xxh3_128_digest("\n".join(parts[i:i + lines]).encode()))
                    places.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(hashes, pa.binary()),
                 pa.array(places, pa.int32())], ["doc_id", "text_id", "window", "pos"])

    return docs.select("doc_id", "text").mapInArrow(tidied(cut), "doc_id long, text_id binary, window binary, pos int")


def repeats(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, text_id, starts): the positions at which a document holds later occurrences."""
    found = windows(docs, lines)
    place = F.struct("doc_id", "pos", "text_id")
    first = (found.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("window", "first"))
    later = found.join(materialize(first, "windows"), "window").where(place != F.col("first"))
    return later.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """Remove later occurrences of repeated windows of lines from ``docs`` (doc_id, text and more).

    Returns the rows and columns of ``docs`` with the text cut, and ``_lines`` and
    ``_removed_lines``. Lines end at a newline. Texts of fewer lines have no window
    and stay, as null and empty texts do; windows of blank lines don't count. Rows
    with equal doc_id and text are one document: all are treated alike. A null
    doc_id sorts first. Where all lines go, the text is empty. Where ``docs`` has
    columns of those two names they stay, and the counts take more underscores.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), _text_id(F.col("text")).alias("k_text"))
    starts = repeats(docs, lines).select(F.col("doc_id").alias("s_id"), F.col("text_id").alias("s_text"), "starts")
    both = keyed.join(starts, keyed.k_id.eqNullSafe(starts.s_id) & (keyed.k_text == starts.s_text), "left")
    parts = F.split("row.text", "\n", -1)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + lines - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), covered)
    cut = F.transform(kept, lambda i: F.get(parts, i))
    found = F.col("starts").isNotNull()
    columns = [
        F.when(found, F.array_join(cut, "\n")).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col("row")[c].alias(c)
        for c in docs.columns]
    return both.select(
        *columns, F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts)).alias(free_name("_lines", docs.columns)),
        F.when(found, F.size(parts) - F.size(kept)).otherwise(0).alias(free_name("_removed_lines", docs.columns)))
