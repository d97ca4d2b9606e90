"""Benchmark decontamination by SimHash of item-sized windows.

A document is read in windows as long as each benchmark item. Windows and items
get 128-bit SimHash fingerprints of their weighted five-word shingles. A
multi-index over blocks of the fingerprint finds every item within the Hamming
radius (of 16 blocks one differs in at most radius / 16 bits), and an exact
similarity of the weighted shingles decides. A window that shares too few
shingles with all items together to be similar to one is not fingerprinted;
that bound loses nothing.

The radius holds for texts without repeated shingles: a repeated one moves many
bits at once. Pairs of which either side repeats a shingle are therefore compared
exactly, by the items that hold a window's shingles, whatever their fingerprints.

Items go to the tasks in parts of bounded size; a large benchmark takes more
passes over the documents, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import _mix, shingles, tidied, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.75
BITS = 128
BLOCKS = 16
#: Two texts of similarity 0.75 differ in 22 of 128 bits on average, with a deviation of 4.
RADIUS = 40
#: Bytes of benchmark text that a task holds at a time.
PART_BYTES = 2 << 20
MATCHES = "doc_id long, item_id long, similarity double, start_word long, end_word long, n_windows long"


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of the 128-bit hash of each shingle."""
    wide = np.stack([hashes, _mix(hashes + np.uint64(0xD1B54A32D192ED03))], axis=1)
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, a byte per block, from the sums of signs."""
    return np.packbits(sums > 0, axis=-1)


def _repeating(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows of a size hold a shingle more than once."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    again = np.full(len(hashes), len(hashes) + size)
    again[order[same]] = order[same + 1]
    return np.minimum.accumulate(again[::-1])[::-1][starts] < starts + size


class Items:
    """The benchmark items of one part, indexed."""

    def __init__(self, ids: list[int | None], texts: list[str | None], radius: int) -> None:
        self.radius = radius
        self.ids, self.words, self.bags = [], [], []
        for (_, words), item in zip(word_hashes(texts), ids):
            if len(words):
                self.ids.append(item)
                self.words.append(len(words))
                self.bags.append(np.unique(shingles(words, SHINGLE_WORDS), return_counts=True))
        prints = [fingerprints(_signs(h).astype(np.int64).T @ c) for h, c in self.bags]
        self.prints = np.array(prints, np.uint8).reshape(-1, BLOCKS)
        self.shingles = np.unique(np.concatenate([h for h, _ in self.bags])) if self.bags else np.zeros(0, np.uint64)
        self.totals = np.array([int(c.sum()) for _, c in self.bags], np.int64)
        self.repeating = np.array([bool((c > 1).any()) for _, c in self.bags], bool)
        # of each shingle in order: the items that hold it, and how often
        sizes = [len(h) for h, _ in self.bags]
        held = np.concatenate([h for h, _ in self.bags]) if self.bags else np.zeros(0, np.uint64)
        order = np.argsort(held, kind="stable")
        self.holders = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.times = (np.concatenate([c for _, c in self.bags]) if self.bags else np.zeros(0, np.int64))[order]
        self.first = np.append(np.searchsorted(held[order], self.shingles), len(held))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = sorted(set(self.words))
        self.length_of = np.array(self.words, np.int64)
        # per length: the items, and for each block and value of it which of them differ by few enough bits there
        self.of_length = {n: np.flatnonzero(np.array(self.words) == n) for n in self.lengths}
        values = np.arange(256, dtype=np.uint8)[None, :, None]
        self.blocks = {
            n: np.bitwise_count(self.prints[own].T[:, None, :] ^ values) <= radius // BLOCKS for n, own in self.of_length.items()}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles occur in some item."""
        out = self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
            out[maybe] = self.shingles[at] == hashes[maybe]
        return out

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint and an item of a length within the radius."""
        near = np.zeros((len(prints), len(self.of_length[length])), bool)
        for b in range(BLOCKS):
            near |= self.blocks[length][b][prints[:, b]]
        at, item = np.nonzero(near)
        item = self.of_length[length][item]
        apart = np.bitwise_count(self.prints[item] ^ prints[at]).sum(axis=1)
        return at[apart <= self.radius], item[apart <= self.radius]

    def alike(self, length: int, own: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[int, float]]:
        """(item, similarity) of the items of a length that are similar to a bag of shingles, exactly."""
        known = self.known(own)
        at, n_at, total = np.searchsorted(self.shingles, own[known]), n[known], int(n.sum())
        sizes = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        item, both = self.holders[place], np.minimum(self.times[place], np.repeat(n_at, sizes))
        fit = self.length_of[item] == length
        item, back = np.unique(item[fit], return_inverse=True)
        both = np.bincount(back, both[fit], len(item)).astype(np.int64)
        found = both / (total + self.totals[item] - both)
        keep = found >= similarity
        yield from zip(item[keep].tolist(), found[keep].tolist())

    def matches(self, words: np.ndarray, similarity: float) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, end) of every similar window of a document."""
        hashes, counts = {}, {}
        for length in self.lengths:
            k = min(SHINGLE_WORDS, length, len(words))
            if not k:
                return
            if k not in hashes:
                hashes[k] = shingles(words, k)
                counts[k] = np.concatenate([[0], np.cumsum(self.known(hashes[k]))])
            if not counts[k][-1]:
                continue
            window = min(length, len(words))  # a shorter document is one window
            m = window - k + 1
            shared = counts[k][m:] - counts[k][:-m]
            needed = similarity * (length - min(SHINGLE_WORDS, length) + 1)
            starts = np.flatnonzero(shared >= needed - 1e-9)
            if not len(starts):
                continue
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * window) + 1):
                part = hashes[k][run[0]:run[-1] + m]
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(part), axis=0, dtype=np.int32)])
                prints = fingerprints(sums[run - run[0] + m] - sums[run - run[0]])
                repeating = _repeating(part, run - run[0], m)
                every = bool(self.repeating[self.of_length[length]].any())
                for at in np.flatnonzero(repeating | every).tolist():
                    start = int(run[at])
                    bag = np.unique(hashes[k][start:start + m], return_counts=True)
                    for i, found in self.alike(length, *bag, similarity):
                        if repeating[at] or self.repeating[i]:
                            yield i, found, start, start + window
                last = -1
                for at, i in zip(*(x.tolist() for x in self.candidates(length, prints))):
                    if repeating[at] or self.repeating[i]:
                        continue
                    start = int(run[at])
                    if start != last:
                        last, (own, n) = start, np.unique(hashes[k][start:start + m], return_counts=True)
                    found = weighted_similarity(own, n, *self.bags[i])
                    if found >= similarity:
                        yield i, found, start, start + window


def weighted_similarity(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weight of each shingle."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (int(n.sum()) + int(m.sum()) - both)


def matches(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that it holds a passage like.

    One row per row of ``docs`` and item: the best similarity, the words it lies at
    (the first of equal ones; words are runs of bytes other than ASCII white space,
    A-Z in lower case), and how many windows are similar. Null and empty texts and
    items match nothing; fewer than five words make one shingle. Repeated rows
    give repeated results. An empty table on either side gives no rows.
    """
    return _keyed_matches(docs, benchmark, similarity, radius, part_bytes).drop("text_key")


def _keyed_matches(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, part_bytes: int) -> DataFrame:
    """The rows of matches(), and ``text_key``, a hash of the document's text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // part_bytes) + 1

    def one(part: int) -> DataFrame:
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").collect()
        items = [(r.item_id, r.text) for r in sorted(own, key=lambda r: (r.item_id is None, r.item_id, r.text or ""))]
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items([i for i, _ in shared.value], [t for _, t in shared.value], radius)
            for batch in batches:
                ids, keys, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
                for at, words in word_hashes(batch.column(1).to_pylist()):
                    best: dict[int, list] = {}
                    for i, found, start, end in index.matches(words, similarity):
                        row = best.setdefault(i, [found, start, end, 0])
                        row[3] += 1
                        if (-found, start) < (-row[0], row[1]):
                            row[:3] = found, start, end
                    out += [(ids[at], index.ids[i], *row, keys[at]) for i, row in best.items()]
                columns = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "similarity", "start_word", "end_word", "n_windows", "text_key"])

        return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidied(find), MATCHES + ", text_key long")

    return reduce(DataFrame.unionByName, map(one, range(parts)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no passage like a benchmark item, with all their columns.

    A row is known by its doc_id, null or not, and a hash of its text: of rows that
    share an id only those go whose own text holds a passage.
    """
    found = _keyed_matches(docs, benchmark, similarity, RADIUS, PART_BYTES).select(
        F.col("doc_id").alias("leaked_id"), F.col("text_key").alias("leaked_key")).distinct()
    return docs.join(
        found, docs.doc_id.eqNullSafe(found.leaked_id) & (F.xxhash64(docs.text) == found.leaked_key), "left_anti")
