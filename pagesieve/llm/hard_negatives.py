"""Hard negatives of anchors by coordinate pruning of inner products.

Vectors are sorted by length and cut into buckets of a bounded size. A bucket keeps,
for each coordinate of its vectors' directions, the list of them in order. Anchors
come in blocks that every task holds whole; a task goes through its buckets, longest
first, and keeps for each anchor what is best so far. That gives a score to reach, so
an angle to the anchor within which a vector of the bucket must lie, and so for
the anchor's largest coordinates, its focus, a range of feasible values. The ranges
are found in the sorted lists, the sets of vectors in them are intersected, and only
what is left is verified by its exact inner product.

The most similar rows of the same label are found first. Each of them then gives a
window of scores in which the best rows of other labels are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import materialize

#: Vectors of a bucket, and the coordinates of an anchor whose ranges are intersected.
BUCKET, FOCUS = 1024, 4
#: Anchors that are sent to the tasks at a time, by count and by bytes.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Anchors whose candidates in a bucket are verified at a time; bounds the scratch memory.
TURN = 1024
#: Vectors of a squared length beyond this take no part: their scores could leave 64 bits.
LONGEST = float(1 << 56)
#: What rounding may move a direction's coordinate, at most.
SLACK = 1e-9

_NONE = np.iinfo(np.int64).max


@dataclass
class Bucket:
    """Vectors of similar length with their sorted coordinate lists."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: for each coordinate, the vectors in order of its value in their directions
    lists: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Bucket:
        return cls(ids, labels, vectors, np.argsort(directions(vectors), axis=0, kind="stable").T.astype(np.uint16))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a zero vector stays."""
    size = lengths(vectors)
    return vectors / np.where(size > 0, size, 1)[:, None]


_BUCKETS = "dim int, n int, longest double, ids binary, labels binary, vectors binary, lists binary"


def quantised(vector: Column, factor: int = 256) -> Column:
    """Each component as the floor of its product with a factor; null for a null vector and where one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def buckets(rows: DataFrame) -> DataFrame:
    """A row for each bucket of ``rows`` (vec_id, label, vector, dim, length); sorted by ranges, so no task holds all of a length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            vectors = np.array([v for _, _, v in held], np.int64).reshape(len(held), -1)
            small = np.int32 if np.abs(vectors).max(initial=0) < 1 << 31 else np.int64
            made = Bucket.of(np.array([i for i, _, _ in held]), np.array([b for _, b, _ in held]), vectors)
            values = [vectors.shape[1], len(held), float(lengths(vectors).max(initial=0)), made.ids.astype("<i8").tobytes(),
                      made.labels.astype("<i8").tobytes(), vectors.astype(small).tobytes(), made.lists.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(("dim", "n", "longest", "ids", "labels", "vectors", "lists"), values))], schema)

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(3))
            for row in zip(*columns):
                if held and (len(held) == BUCKET or len(held[0][2]) != len(row[2])):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("vectors", pa.binary()), ("lists", pa.binary())])
    order = [F.col("dim"), F.col("length").desc(), F.col("vec_id"), F.col("row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.select("vec_id", "label", "vector").mapInArrow(cut, _BUCKETS), "buckets")


class Best:
    """The first k finds of each window of each anchor: higher scores first, ties by smaller id."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int) -> None:
        self.width, self.k = least.shape[1], k
        self.most = most.ravel()
        # what a find must beat: a score, and at the same score an id
        self.score = np.where(least > most, _NONE, least).ravel()
        self.id = np.full(len(self.score), _NONE)
        self.kept: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def reach(self) -> np.ndarray:
        """The score that a vector needs to be of use to an anchor."""
        return self.score.reshape(-1, self.width).min(1)

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.width):
            slot = anchor * self.width + w
            least = self.score[slot]
            good = (score <= self.most[slot]) & ((score > least) | ((score == least) & (ids < self.id[slot])))
            if good.any():
                self.new.append((slot[good], score[good], ids[good]))
                self.waiting += int(good.sum())
        if self.waiting > 10_000 + len(self.kept[0]) // 2:
            self.merge()

    def merge(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        keep = rank < self.k
        self.kept = slot[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.score[slot[last]], self.id[slot[last]] = score[last], ids[last]
        self.new, self.waiting = [], 0


@dataclass
class Anchors:
    """Anchors of one dimension and the windows of scores in which finds for them lie."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def __post_init__(self) -> None:
        self.length = lengths(self.vectors)
        along = directions(self.vectors)
        self.focus = np.argsort(-np.abs(along), axis=1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(along, self.focus, 1), -1, 1))


def feasible(anchors: Anchors, which: np.ndarray, reach: np.ndarray, bucket: Bucket, along: np.ndarray) -> np.ndarray:
    """Whether each vector of a bucket can reach the score that each of some anchors needs.

    By the angle: what is within t of an anchor, which is at a from a coordinate's
    axis, is between a - t and a + t from that axis.
    """
    longest = lengths(bucket.vectors).max(initial=0)
    bound = anchors.length[which] * longest
    mask = np.ones((len(which), len(bucket.ids)), bool)
    mask[(reach > 0) & (reach * (1 - SLACK) > bound)] = False
    sharp = np.flatnonzero((reach > 0) & mask[:, 0])
    if not len(sharp):
        return mask
    turn = np.arccos(np.minimum(1, reach[sharp] * (1 - SLACK) / bound[sharp]))
    angle = anchors.angle[which[sharp]]
    low = np.cos(np.minimum(np.pi, angle + turn[:, None])) - SLACK
    high = np.cos(np.maximum(0, angle - turn[:, None])) + SLACK
    focus = anchors.focus[which[sharp]]
    for f in np.unique(focus):
        row, k = np.nonzero(focus == f)
        order = bucket.lists[f]
        values = along[order, f]
        begin, end = np.searchsorted(values, low[row, k]), np.searchsorted(values, high[row, k], "right")
        cuts = (begin > 0) | (end < len(values))
        if cuts.any():
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            mask[sharp[row[cuts]]] &= (rank >= begin[cuts, None]) & (rank < end[cuts, None])
    return mask


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if lengths(a).max(initial=0) * lengths(b).max(initial=0) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def search(anchors: Anchors, best: Best, bucket: Bucket, same_label: bool) -> int:
    """Offer a bucket's vectors to the best finds; returns how many candidates were verified."""
    along, verified = directions(bucket.vectors), 0
    for a in range(0, len(anchors.ids), TURN):
        reach = best.reach()[a:a + TURN]
        which = a + np.flatnonzero(reach < _NONE)
        mask = feasible(anchors, which, reach[which - a].astype(np.float64), bucket, along)
        mask &= (anchors.labels[which, None] == bucket.labels) == same_label
        mask &= anchors.ids[which, None] != bucket.ids
        rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(rows):
            continue
        mask = mask[np.ix_(rows, columns)]
        verified += int(mask.sum())
        which = which[rows]
        if 8 * mask.sum() < mask.size:
            # few are left: each by itself
            i, j = np.nonzero(mask)
            left, right = anchors.vectors[which], bucket.vectors[columns]
            parts = [np.einsum("nd,nd->n", left[i[p:p + 50_000]].astype(np.int64), right[j[p:p + 50_000]].astype(np.int64))
                     for p in range(0, len(i), 50_000)]
            score = np.concatenate(parts)
            good = score >= best.reach()[which[i]]
            i, j, score = i[good], j[good], score[good]
        else:
            every = products(anchors.vectors[which], bucket.vectors[columns])
            i, j = np.nonzero(mask & (every >= best.reach()[which][:, None]))
            score = every[i, j]
        best.offer(which[i], score, bucket.ids[columns[j]])
    return verified


def _found(table: DataFrame, blocks: list[Anchors], k: int, same_label: bool) -> DataFrame:
    """(number, w, vec_id, score, rank): the first k finds for each window of a block's anchors, of all buckets."""
    shared = table.sparkSession.sparkContext.broadcast({x.vectors.shape[1]: x for x in blocks})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {dim: Best(x.least, x.most, k) for dim, x in shared.value.items()}
        for batch in batches:
            for dim, n, ids, labels, vectors, lists in zip(*(batch.column(c) for c in ("dim", "n", "ids", "labels", "vectors", "lists"))):
                anchors = shared.value.get(dim.as_py())
                if anchors is None:
                    continue
                data, n, dim = vectors.as_py(), n.as_py(), dim.as_py()
                kind = np.int64 if len(data) == 8 * n * dim else np.int32
                search(anchors, states[dim], Bucket(
                    np.frombuffer(ids.as_py(), np.int64), np.frombuffer(labels.as_py(), np.int64),
                    np.frombuffer(data, kind).reshape(n, dim), np.frombuffer(lists.as_py(), np.uint16).reshape(dim, n)), same_label)
        for dim, best in states.items():
            best.merge()
            slot, score, ids = best.kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value[dim].number[slot // best.width]), pa.array((slot % best.width).astype(np.int32)), pa.array(ids), pa.array(score)],
                ["number", "w", "vec_id", "score"])

    found = table.mapInArrow(read, "number long, w int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number", "w").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(rows: pa.Table) -> list[Anchors]:
    """The anchors of a block, by dimension, with one window that holds every score."""
    dims, out = np.array(rows["dim"]), []
    for dim in np.unique(dims):
        own = rows.filter(pa.array(dims == dim))
        vectors = np.array(own["vector"].combine_chunks().flatten(), np.int64).reshape(own.num_rows, dim)
        n = own.num_rows
        out.append(Anchors(np.array(own["number"]), np.array(own["vec_id"]), np.array(own["label"]), vectors,
                           np.full((n, 1), -_NONE), np.full((n, 1), _NONE - 1)))
    return out


def _windows(blocks: list[Anchors], positives: list, k: int, low: int, high: int) -> list[Anchors]:
    """The same anchors with a window for each positive: low to high hundredths of its score."""
    by_number: dict[int, list] = {}
    for row in positives:
        by_number.setdefault(row.number, []).append(row)
    out = []
    for x in blocks:
        least, most = np.full((len(x.ids), k), 0), np.full((len(x.ids), k), -1)
        for i, number in enumerate(x.number.tolist()):
            for row in by_number.get(number, ()):
                least[i, row.rank - 1], most[i, row.rank - 1] = -(-low * row.score // 100), high * row.score // 100
        out.append(Anchors(x.number, x.ids, x.labels, x.vectors, least, most))
    return out


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, vector of whole numbers).

    Rows where one of the three, or a component, is null take no part, nor does what is longer than
    ``LONGEST``; further columns are ignored. For each row that is an ``anchor``, its
    positives are the first rows of its label with another id, and for each of those
    the negatives the first rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``. Higher inner products come first, ties by
    smaller vec_id; all are taken if there are fewer. Vectors of different dimension
    don't meet. Repeated rows count each, and repeated anchors have their own results.
    Empty tables give no rows.
    """
    whole = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    valid = materialize(rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"),
                                    F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
                        .where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
                        .withColumn("length", whole).where(F.col("length") < LONGEST)
                        .withColumn("dim", F.size("vector")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    table = buckets(valid.drop("is_anchor", "number"))
    chosen = valid.where("is_anchor")
    n, widest = chosen.agg(F.count(F.lit(1)), F.max("dim")).first()
    blocks = -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, widest or 1)))))
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", "vec_id", "label", "vector", "dim")
        block = _block(own.toArrow())
        near = materialize(_found(table, block, positives, True), "positives")
        far = _found(table, _windows(block, near.collect(), positives, low, high), negatives, False)
        named = near.join(own.select("number", F.col("vec_id").alias("anchor_id")), "number").select(
            "number", "anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = far.join(named, ["number", "w"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(materialize(done, "negatives"))
    return out
