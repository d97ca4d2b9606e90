"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled into the unit ball and lifted onto the sphere, so that the
largest inner product is the smallest distance. Each table hashes them by
projections on Gaussian directions, cut into cells of a width. A query visits its
own bucket and then buckets with one or more cells exchanged for a neighbouring
one, in the order in which they are expected to succeed: from the squared
distances to the cell walls, sorted, and the order of sets of walls that is
expected for any query. What all tables hold in visited buckets is ranked exactly.

Buckets are dealt into regions; a region's vectors and the queries that visit it
meet in blocks of bounded size of both, and only the best of each leave a block.
Equal vectors are one entry with their smallest ids, of which more could not
appear in any answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import materialize

#: Vectors and queries that meet in one task: at most about twice as many of each.
REGION_VECTORS = 8192
REGION_QUERIES = 16_384
#: Vectors, and their bytes, from which the number of visits is fitted; queries among them; the share of neighbours to be met.
SAMPLE_VECTORS, SAMPLE_BYTES, SAMPLE_QUERIES, AIM = 8192, 32 << 20, 400, 0.97


@dataclass(frozen=True)
class Tables:
    """Tables, directions in each, width of a cell, and buckets visited in a table."""

    tables: int = 6
    hashes: int = 8
    width: float = 2.0
    probes: int = 160
    seed: int = 7

    @staticmethod
    def for_rows(n: int) -> Tables:
        """Buckets as fine as half the bits of the row count, and more visits where they are finer."""
        hashes = max(4, int(np.ceil(np.log2(max(n, 2)) / 2)))
        return Tables(hashes=hashes, probes=int(160 * 1.6 ** max(0, hashes - 8)))


@cache
def probe_order(hashes: int, probes: int) -> np.ndarray:
    """Sets of sorted walls (0-based, padded by 2 * hashes) in the order of their expected squared distance."""
    m = 2 * hashes
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    k = m + 1 - j
    cost = np.where(j <= hashes, low, 1 - k / (hashes + 1) + k * (k + 1) / (4 * (hashes + 1) * (hashes + 2)))
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, walls = heapq.heappop(heap)
        if all(m - 1 - w not in walls for w in walls):  # not both walls of one direction
            found.append(walls)
        last = walls[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*walls, last + 1)))
    out = np.full((len(found), max(1, max(map(len, found)))), m)
    for i, walls in enumerate(found):
        out[i, :len(walls)] = walls
    return out


def _hashed(vectors: np.ndarray, table: int, params: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys, places in the cells, and the factor of each direction in the key."""
    rng = np.random.default_rng([params.seed, table])
    directions = rng.normal(size=(vectors.shape[1], params.hashes))
    shift = rng.uniform(0, 1, params.hashes)
    factors = rng.integers(1, 1 << 62, params.hashes).astype(np.uint64) | np.uint64(1)
    place = vectors @ directions / params.width + shift
    cell = np.floor(place)
    return (cell.astype(np.int64).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64), place - cell, factors


def bucket_keys(vectors: np.ndarray, table: int, params: Tables) -> np.ndarray:
    return _hashed(vectors, table, params)[0]


def probed_keys(vectors: np.ndarray, table: int, params: Tables) -> np.ndarray:
    """The keys of the buckets each query visits, in order."""
    keys, place, factors = _hashed(vectors, table, params)
    walls = np.concatenate([place, 1 - place], axis=1) ** 2
    order = np.argsort(walls, axis=1)
    step = np.where(order < params.hashes, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)) * factors[order % params.hashes]
    step = np.concatenate([step, np.zeros((len(keys), 1), np.uint64)], axis=1)
    return keys[:, None] + step[:, probe_order(params.hashes, params.probes)].sum(axis=2, dtype=np.uint64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors over the largest norm, with one more component that makes their norm 1."""
    scaled = vectors / largest
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(axis=1, keepdims=True)))], axis=1)


def lifted_queries(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)


def fitted(sample: np.ndarray, n: int, k: int, params: Tables) -> Tables:
    """``params`` with no more visits than the nearest of a sample of ``n`` vectors need.

    A query's share of its k nearest among the sample stands for all k: they are
    as far away as those, or farther where the share is less than one vector. Where
    vectors lie in clusters few visits do; where they are random all are kept.
    """
    few = min(len(sample) - 1, max(1, -(-k * len(sample) // n)))
    if few < 1:
        return params
    asked = np.unique(np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, few - 1, axis=1)[:, :few]
    above, own = lifted(sample, float(np.linalg.norm(sample, axis=1).max())), lifted_queries(sample[asked])
    first = np.full(best.shape, params.probes)
    for table in range(params.tables):
        keys = bucket_keys(above, table, params)[best]
        for row, wanted, probes in zip(first, keys, probed_keys(own, table, params)):
            met = probes[None, :] == wanted[:, None]
            np.minimum(row, np.where(met.any(axis=1), met.argmax(axis=1), params.probes), out=row)
    needed = int(np.sort(first, axis=None)[int(np.ceil(AIM * first.size)) - 1]) + 1
    return replace(params, probes=min(params.probes, needed))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, key, vec, norm) of the vectors that take part; key is the same for equal vectors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, out, norms = [], [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not values.is_valid or values.values.null_count:
                    continue
                own = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                norm = float(np.linalg.norm(own))
                if not len(own) or not np.isfinite(own).all() or norm == 0:
                    continue
                ids.append(vec_id)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                out.append(own)
                norms.append(norm)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.float64())), pa.array(norms, pa.float64())],
                ["vec_id", "key", "vec", "norm"])

    return vectors.select("vec_id", column).mapInArrow(read, "vec_id long, key binary, vec array<double>, norm double")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:  # all that tie with the k-th stay for the exact order
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def inner_products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of each row with the query; equal rows have equal ones wherever they stand, unlike in a matrix product."""
    return (matrix * query).sum(axis=1)


def _near_best(rough: np.ndarray, k: int, longest: float) -> np.ndarray:
    """Places that may be among the k best, given scores that are off by rounding; ``longest`` bounds the norms' product."""
    if len(rough) <= 4 * k:
        return np.arange(len(rough))
    least = np.partition(rough, len(rough) - k)[len(rough) - k]
    return np.flatnonzero(rough >= least - longest * 1e-12)


_FOUND = pa.schema([("q_key", pa.binary()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
_FOUND_DDL = "q_key binary, scores array<double>, ids array<long>"


def _meet(k: int, everything: bool):
    def meet(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return _FOUND.empty_table()
        vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
        bucket = vectors["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        matrix = _matrix(vectors["vec"].combine_chunks())[order]
        members = [vectors["members"][int(i)].as_py() for i in order]
        single = np.array([m[0] for m in members])
        copies = np.flatnonzero(np.array([len(m) for m in members]) > 1)
        longest = float(np.sqrt((matrix ** 2).sum(axis=1).max()))
        out = []
        for q_key, own, probes in zip(queries["q_key"], _matrix(queries["vec"].combine_chunks()), queries["probes"]):
            if everything:
                at = np.arange(len(bucket))
            else:
                wanted = probes.values.to_numpy()
                first, end = np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, "right")
                spans = [np.arange(a, b) for a, b in zip(first, end) if b > a]
                if not spans:
                    continue
                at = np.unique(np.concatenate(spans))
            at = at[_near_best(matrix[at] @ own, k, longest * float(np.linalg.norm(own)))]
            scores, ids = inner_products(matrix[at], own), single[at]
            more = np.intersect1d(at, copies) if len(copies) else copies
            if len(more):
                again = scores[np.searchsorted(at, more)]
                scores = np.concatenate([scores, *(np.full(len(members[i]) - 1, s) for i, s in zip(more.tolist(), again))])
                ids = np.concatenate([ids, *(members[i][1:] for i in more.tolist())])
            scores, ids = _best(scores, ids, k)
            out.append((q_key.as_py(), scores, ids))
        columns = list(zip(*out)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return meet


def _merge(k: int):
    def merge(key: tuple, found: pa.Table) -> pa.Table:
        scores = np.concatenate([x.values.to_numpy() for x in found["scores"]])
        ids = np.concatenate([x.values.to_numpy() for x in found["ids"]])
        order = np.lexsort((-scores, ids))
        scores, ids = scores[order], ids[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])  # a vector found in several tables counts once
        scores, ids = _best(scores[first], ids[first], k)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.binary()), pa.array([scores], pa.list_(pa.float64())), pa.array([ids], pa.list_(pa.int64()))], schema=_FOUND)

    return merge


def _search(entries: DataFrame, queries: DataFrame, largest: float, params: Tables, regions: int, k: int, everything: bool) -> DataFrame:
    """The best k of each query (q_key, vec) among the visited entries (key, vec, members)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            above = lifted(_matrix(batch.column("vec")), largest)
            for table in range(1 if everything else params.tables):
                keys = bucket_keys(above, table, params)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), table), pa.int32()), pa.array((keys % np.uint64(regions)).astype(np.int32)),
                     pa.array(keys.view(np.int64)), batch.column("key"), batch.column("vec"), batch.column("members")],
                    ["tbl", "region", "bucket", "key", "vec", "members"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            above = lifted_queries(_matrix(batch.column("vec")))
            for table in range(1 if everything else params.tables):
                at, where, probes = [], [], []
                for i, keys in enumerate(probed_keys(above, table, params)):
                    if everything:
                        at += [i] * regions
                        where += range(regions)
                        probes += [[]] * regions
                        continue
                    keys = keys[np.argsort(keys % np.uint64(regions), kind="stable")]
                    region = (keys % np.uint64(regions)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(region)) + 1
                    for part in np.split(np.arange(len(keys)), cuts):
                        at.append(i)
                        where.append(int(region[part[0]]))
                        probes.append(np.unique(keys[part].view(np.int64)))
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), table), pa.int32()), pa.array(where, pa.int32()), own.column("q_key"), own.column("vec"),
                     pa.array(probes, pa.list_(pa.int64()))], ["tbl", "region", "q_key", "vec", "probes"])

    placed = materialize(entries.select("key", "vec", "members").mapInArrow(
        place, "tbl int, region int, bucket long, key binary, vec array<double>, members array<long>"), "placed")
    visits = materialize(queries.select("q_key", "vec").mapInArrow(
        visit, "tbl int, region int, q_key binary, vec array<double>, probes array<long>"), "visits")

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("tbl", "region").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).cast("int").alias(name))

    # a region that came out large, or is visited by many, is met in several blocks of vectors and of queries
    parts = blocks(placed, REGION_VECTORS, "parts").join(blocks(visits, REGION_QUERIES, "turns"), ["tbl", "region"])

    def block(key: str, of: str):
        return F.pmod(F.xxhash64(key), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = placed.join(parts, ["tbl", "region"]).withColumn("part", block("key", "parts")).withColumn("turn", every("turns"))
    right = visits.join(parts, ["tbl", "region"]).withColumn("turn", block("q_key", "turns")).withColumn("part", every("parts"))
    left, right = left.drop("parts", "turns", "key"), right.drop("parts", "turns")
    keys = ["tbl", "region", "part", "turn"]
    met = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_meet(k, everything), _FOUND_DDL)
    return met.groupBy("q_key").applyInArrow(_merge(k), _FOUND_DDL)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, column: str = "embedding", params: Tables | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` whose vec_id ``every`` divides, the k nearest others found.

    Nearness is the inner product in double precision; ties go to the smaller
    vec_id. Rows with a null vec_id and vectors that are null, empty, zero, or hold
    nulls or non-finite numbers take no part, nor do those whose length isn't the
    most frequent one. Equal rows are one row. Where the visited buckets hold fewer
    than k, all vectors are searched. More columns are ignored; no rows give none.
    """
    read = materialize(usable(vectors, column).withColumn("size", F.size("vec")), "vectors")
    size = read.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = read.where(F.col("size") == size["size"])
    largest = rows.agg(F.max("norm")).first()[0]
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    entries = materialize(
        rows.select("vec_id", "key", "vec").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
        .groupBy("key").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("members")), "entries")
    n = entries.count()
    if params is None:
        few = max(256, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * size["size"])))
        sample = entries.orderBy(F.xxhash64("key"), "key").limit(few).select("vec").toArrow()
        params = fitted(_matrix(sample["vec"].combine_chunks()), n, k, Tables.for_rows(n))
    regions = -(-n // REGION_VECTORS)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("key").alias("q_key")).distinct()
    queries = materialize(
        entries.join(asked.select(F.col("q_key").alias("key")).distinct(), "key", "left_semi").withColumnRenamed("key", "q_key"), "queries")
    found = materialize(_search(entries, queries, largest, params, regions, k + 1, False), "found")
    least = min(k + 1, rows.select("vec_id", "key").distinct().limit(k + 1).count())
    short = materialize(queries.join(found.where(F.size("ids") >= least), "q_key", "left_anti"), "short")
    if not short.isEmpty():
        more = _search(entries, short, largest, params, regions, k + 1, True)
        found = found.join(short, "q_key", "left_anti").unionByName(more)
    pairs = F.arrays_zip("ids", "scores")
    own = F.filter(pairs, lambda p: p["ids"] != F.col("query_id"))
    return (asked.join(found, "q_key").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "pair"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("pair.ids").alias("vec_id"), F.col("pair.scores").alias("score")))
