"""Resharding by minimum-cost flow.

The files of a table lie in old shards. New capacities may differ in number and
size. A flow network with an arc from each old to each new shard, free where a
shard keeps its bytes and one per byte elsewhere, gives the transfers that move
the fewest bytes. Each transfer takes whole blocks of rows and cuts at most one
block, at the row nearest the wanted byte. Files of which some rows leave their
shard are written anew; all others stay as they are.

Blocks are runs of rows of a file, so no key, source or group of copies can make
one large. The driver sees block totals, whose number is bounded, never rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.session import shared_dir

#: Blocks whose totals the driver reads, besides one for each file.
MAX_BLOCKS = 16_384
MIN_BLOCK_ROWS = 64
#: File names up to which a list of them is a scan filter and a table of row ranges is broadcast.
FILES_IN_FILTER = 10_000


def minimum_cost_flow(supply: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """Bytes each old shard (row) sends to each new one; a shard keeping its own number is free.

    Successive cheapest paths over the residual network; supplies must fit the capacities.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    for home in range(min(n, m)):  # the free arcs carry what they can: no cheaper path exists
        moved = min(left[home], room[home])
        flow[home][home] += moved
        left[home] -= moved
        room[home] -= moved
    while any(left):
        cost: dict[tuple[int, int], int] = {(0, i): 0 for i in range(n) if left[i]}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        queue = deque(cost)
        while queue:
            node = queue.popleft()
            side, i = node
            steps = ([((1, j), int(i != j)) for j in range(m)] if side == 0
                     else [((0, k), -int(k != i)) for k in range(n) if flow[k][i]])
            for to, price in steps:
                if cost[node] + price < cost.get(to, 1 << 62):
                    cost[to], came[to] = cost[node] + price, node
                    queue.append(to)
        node = min(((1, j) for j in range(m) if room[j]), key=lambda x: (cost[x], x))
        path = [node]
        while node in came:
            node = came[node]
            path.append(node)
        path.reverse()
        arcs = [(a[1], b[1], 1) if a[0] == 0 else (b[1], a[1], -1) for a, b in zip(path, path[1:])]
        moved = min([left[path[0][1]], room[path[-1][1]], *(flow[i][j] for i, j, sign in arcs if sign < 0)])
        for i, j, sign in arcs:
            flow[i][j] += sign * moved
        left[path[0][1]] -= moved
        room[path[-1][1]] -= moved
    return flow


@dataclass(frozen=True)
class Range:
    """Rows of a file that go to one shard, and the number there of the first."""

    file: str
    first: int
    end: int
    old: int
    shard: int
    slot: int


@dataclass(frozen=True)
class Resharded:
    """The new layout: files that stay, a folder of rewritten rows, and the bytes moved."""

    source: str
    target: str
    kept: list[Range]
    rewritten: list[Range]
    moved_bytes: int
    capacities: list[int]


def _origin(docs: DataFrame) -> tuple[Column, Column]:
    """File and place in it of each row, also where the table has a column ``_metadata`` of its own."""
    origin = docs.metadataColumn("_metadata")
    return origin["file_path"], origin["row_index"]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _plan(
    docs: DataFrame, size: Column, new_capacities: Callable[[int], Sequence[int]], old_shards: int,
) -> tuple[list[Range], int, list[int]]:
    in_file, place = _origin(docs)
    rows = docs.select(in_file.alias("file"), place.alias("row"), size.cast("long").alias("size"))
    counts = {r.file: r.n for r in docs.groupBy(in_file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
    block_rows = max(MIN_BLOCK_ROWS, -(-sum(counts.values()) // MAX_BLOCKS))
    block = F.floor(F.col("row") / block_rows)
    blocks = sorted(
        (r.file, r.block, r.bytes)
        for r in rows.groupBy("file", block.alias("block")).agg(F.sum("size").alias("bytes")).collect())
    home = {file: k % old_shards for k, file in enumerate(sorted(counts))}
    supply = [0] * old_shards
    for file, _, n in blocks:
        supply[home[file]] += n
    capacities = list(new_capacities(sum(supply)))
    flow = minimum_cost_flow(supply, capacities)

    # Where a shard's run of blocks is cut: (file, block) -> byte offsets in the block, and who takes what follows.
    marks: list[tuple[str, int, int, int]] = []
    for old in range(old_shards):
        order = sorted((j for j in range(len(capacities)) if flow[old][j]), key=lambda j: (j != old, j))
        ends, total = [], 0
        for j in order[:-1]:
            total += flow[old][j]
            ends.append(total)
        at, k = 0, 0
        takes = iter(order)
        for file, b, n in (x for x in blocks if home[x[0]] == old):
            if not at:
                marks.append((file, b, 0, next(takes, old)))
            while k < len(ends) and ends[k] < at + n:
                marks.append((file, b, ends[k] - at, next(takes)))
                k += 1
            at += n
    inner = [(f, b, offset, k) for k, (f, b, offset, _) in enumerate(marks) if offset]
    row_of: dict[int, int] = {}
    if inner:
        cuts = docs.sparkSession.createDataFrame(inner, "file string, block long, offset long, mark int")
        near = rows.withColumn("block", block).join(F.broadcast(cuts.select("file", "block").distinct()), ["file", "block"])
        before = near.select("file", "block", "row", "size", F.sum("size").over(_up_to()).alias("upto"))
        # a cut falls before the first row whose middle lies beyond the offset
        found = (before.join(F.broadcast(cuts), ["file", "block"]).where("2 * upto - size <= 2 * offset")
                 .groupBy("mark").agg((F.max("row") + 1).alias("row")).collect())
        row_of = {r.mark: r.row for r in found}
    starts: dict[str, list[tuple[int, int]]] = {}
    for k, (file, b, _, shard) in enumerate(marks):
        starts.setdefault(file, []).append((row_of.get(k, b * block_rows), shard))

    spans, current = [], {}
    for file in sorted(counts):
        old = home[file]
        edges = [(0, current.get(old, old)), *starts.get(file, [])]
        current[old] = edges[-1][1]
        for (first, shard), end in zip(edges, [*(e[0] for e in edges[1:]), counts[file]]):
            if end > first:
                spans.append((file, first, end, old, shard))
    slots = [0] * len(capacities)
    ranges = []
    for file, first, end, old, shard in sorted(spans, key=lambda s: (s[3] != s[4], s[0], s[1])):
        ranges.append(Range(file, first, end, old, shard, slots[shard]))
        slots[shard] += end - first
    moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    return ranges, moved, capacities


def _up_to():
    from pyspark.sql import Window

    return Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)


def _placed(docs: DataFrame, ranges: list[Range], *columns: Column) -> DataFrame:
    """The rows of the ranges as (columns, shard, slot)."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r.file, r.first, r.end, r.shard, r.slot) for r in ranges],
        "r_file string, r_first long, r_end long, r_shard int, r_slot long")
    in_file, place = _origin(docs)
    rows = docs.select(*columns, in_file.alias("r_file"), place.alias("r_row"))
    if len(ranges) <= FILES_IN_FILTER:
        table = F.broadcast(table)
        rows = rows.where(F.col("r_file").isin(sorted({r.file for r in ranges})))
    on = (F.col("r_row") >= F.col("r_first")) & (F.col("r_row") < F.col("r_end"))
    names = [c for c in rows.columns if c not in ("r_file", "r_row")]
    return (rows.join(table, "r_file").where(on)
            .select(*names, F.col("r_shard").alias("shard"), (F.col("r_slot") + F.col("r_row") - F.col("r_first")).alias("slot")))


def reshard(
    spark: SparkSession, path: str, capacities: Sequence[int] | int, size: Column, old_shards: int | None = None,
    target: str | None = None,
) -> Resharded:
    """Bring the Parquet table at ``path`` from its old shards into shards of the given capacities.

    File k in order of name lies in old shard k mod ``old_shards`` (the number of new
    ones unless given). ``capacities`` are in the unit of ``size``, which must be
    positive for every row, or a number of equal shards. Rows keep the order of
    file and place in it; those that stay come first, so a slot is fixed even among
    equal rows. Shards come within one row of their capacity. Nulls and extra
    columns are carried along; an empty table gives no ranges.
    """
    shards = capacities if isinstance(capacities, int) else len(capacities)
    fixed = (lambda total: equal_capacities(total, shards)) if isinstance(capacities, int) else lambda _: capacities
    docs = spark.read.parquet(path)
    ranges, moved, new = _plan(docs, size, fixed, old_shards or shards)
    leaving = {r.file for r in ranges if r.old != r.shard}
    kept = [r for r in ranges if r.file not in leaving]
    rewritten = [r for r in ranges if r.file in leaving]
    target = target or f"{shared_dir(spark, 'shards')}/rewritten"
    (_placed(docs, rewritten, F.struct("*").alias("row"))
     .withColumn("in_shard", F.col("shard")).write.partitionBy("in_shard").parquet(target))
    return Resharded(path, target, kept, rewritten, moved, new)


def read_shards(spark: SparkSession, layout: Resharded) -> DataFrame:
    """(row, shard, slot) of the whole new layout: files that stayed, and those written."""
    docs = spark.read.parquet(layout.source)
    kept = _placed(docs, layout.kept, F.struct("*").alias("row"))
    written = spark.read.schema(kept.schema).option("recursiveFileLookup", True).parquet(layout.target)
    return kept.unionByName(written)
