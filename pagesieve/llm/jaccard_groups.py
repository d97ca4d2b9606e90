"""Near duplicates by Jaccard similarity of word shingles, with a token-group matrix.

Equal shingle sets become one class. Classes that share a minimum hash are
compared with the most central of them, and those found similar are one component
so far. Under an order of all tokens by frequency, two sets of the wanted similarity
share one of their first quarter of tokens, the earlier the more alike they are in
size. Only classes that share such a token with one of another component go on. In
homes of many of them, the classes of one centre, some then stand for the component
that leads the home and are compared with the rest, in proportion to their number.

What is left of a home, similar or not, forms groups of the token-group matrix,
in chunks of bounded size. Its rows are the tokens of the members' prefixes. Two
chunks meet only in such a token, and only if they hold classes that aren't in one
component yet. What is sent along is a signature of each class, counts of its tokens
in cells. The union of a chunk's signatures bounds how much of a set any member can
hold, chunks within the bound are opened, members within it by their own signature
are compared exactly. No similar pair of different components is missed; of the
others only the links that hold components together are needed.

Frequencies come from a fixed number of counters over hashed tokens. They only
order tokens, so sharing a counter costs time, never a link: boilerplate and
popular passages come last in the order and do not bring documents together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import _mix, bounded, distinct, materialize, released, shingles, tidied, word_hashes
from pagesieve.llm.components import connected_components

SHINGLE_WORDS = 5
PERCENT = 75
#: Minimum hashes that bring classes together into groups.
HASHES = 12
#: Counters of token frequencies, and the parts in which they are added up.
COUNTERS = 1 << 22
PARTS = 64
#: Texts that a worker holds as strings at a time.
SLICE_ROWS = 1000
#: Classes of one centre whose tokens are united and that are compared together.
CHUNK_CLASSES = 32
#: Rows of a table of tokens alone that may be sent to every executor: 32 MB.
BROADCAST_TOKENS = 1 << 22
#: Classes that stand for the leading group of a large home in a turn, and the turns.
STANDING, TURNS = 16, 2
_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF) for k in range(HASHES)]


def set_id(tokens: np.ndarray) -> int:
    """64 bits of a set of tokens in order, as a signed number."""
    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays of distinct values in order share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, few at a time: their texts are held again as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_FEATURES = ("doc_id long, text_key long, n_shingles long, sid long, mins array<long>, part int, counts binary")


def features(docs: DataFrame) -> DataFrame:
    """Set size, id and minimum hashes of each row; and, with ``part``, the token counts of each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in _slices(batches):
            sizes, ids, mins = [], [], []
            for _, words in word_hashes(batch.column(2).to_pylist()):
                tokens = distinct(shingles(words, SHINGLE_WORDS))
                sizes.append(len(tokens))
                ids.append(set_id(tokens) if len(tokens) else None)
                mins.append([int(_mix(tokens ^ seed).min().view(np.int64)) for seed in _SEEDS] if len(tokens) else None)
                # added in place: tables of as many counters beside it would stay in the worker's heap
                np.add.at(counts, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(mins, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "sid", "mins", "part", "counts"])
        step = COUNTERS // PARTS
        shrink = zstandard.ZstdCompressor(level=1).compress
        own = [shrink(counts[k * step:(k + 1) * step].astype("<u4").tobytes()) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()),
             pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(own, pa.binary())],
            ["doc_id", "text_key", "n_shingles", "sid", "mins", "part", "counts"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidied(read), _FEATURES)


def token_ranks(found: DataFrame) -> np.ndarray:
    """The rank of each counter, rarest first, in 16 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for counts in batch.column(1):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), "<u4").astype(np.int64)
                total = own if total is None else total + own
        part = batch.column(0)[:1]
        data = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([part, pa.array([data], pa.binary())], ["part", "counts"])

    rows = (found.where("part IS NOT NULL").select("part", "counts").groupBy("part")
            .applyInArrow(add, "part int, counts binary").collect())
    counts = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for row in rows:
        counts[row.part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.counts), np.int64)
    order = np.argsort(counts.ravel(), kind="stable")
    del rows, counts
    ranks = np.empty(COUNTERS, np.uint16)
    ranks[order] = np.repeat(np.arange(1 << 16, dtype=np.uint16), COUNTERS >> 16)
    return ranks


def _of(docs: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """(sid, text, more) of the documents that stand for the ``wanted`` classes (sid, one, more), by id and text: ids may be null or repeated."""
    keys = bounded(wanted.select("sid", F.col("one.text_key").alias("key"), F.col("one.doc_id").alias("id"), *more))
    texts = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    return texts.join(keys, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("sid", "text", *more)


def packed(text: str) -> bytes:
    """A text from which ``unpacked`` makes the tokens again: a third of their size, as they don't compress."""
    return zstandard.ZstdCompressor(level=3).compress(text.encode())


@lru_cache(maxsize=4)
def _unpacked(data: bytes) -> np.ndarray:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return distinct(shingles(next(words for _, words in word_hashes([text])), SHINGLE_WORDS))


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    return _unpacked(value.as_py())


def signature(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall into each of about as many cells as there are tokens, by their low bits."""
    cells = 1 << max(6, min(20, int(len(tokens)).bit_length()))
    return np.minimum(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def _read_classes(docs: DataFrame, wanted: DataFrame, pack: Callable[[str, np.ndarray], bytes], name: str) -> DataFrame:
    """(sid, name): what ``pack`` makes of the text and tokens of each of the ``wanted`` classes (sid, one)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sids, out, made, texts = batch.column(0).to_pylist(), [], [], batch.column(1).to_pylist()
            for at, words in word_hashes(texts):
                tokens = distinct(shingles(words, SHINGLE_WORDS))
                if len(tokens) and set_id(tokens) == sids[at]:
                    out.append(sids[at])
                    made.append(pack(texts[at], tokens))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(made, pa.binary())], ["sid", name])

    found = materialize(_of(docs, wanted).mapInArrow(tidied(read), f"sid long, {name} binary"), name)
    # repeated rows may stand for one class
    return found if found.count() <= wanted.count() else materialize(found.dropDuplicates(["sid"]), name)


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens) of the ``wanted`` classes (sid, one), packed."""
    return _read_classes(docs, wanted, lambda text, tokens: packed(text), "tokens")


def signatures(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, cells) of the ``wanted`` classes (sid, one): their signatures, compressed."""
    return _read_classes(docs, wanted, lambda text, tokens: zstandard.ZstdCompressor(level=1).compress(signature(tokens).tobytes()), "cells")


def prefixes(docs: DataFrame, wanted: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(sid, grp, tokens): the rarest tokens of each of the ``wanted`` classes, of which similar sets share one."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sids, keep, sets = batch.column(0).to_pylist(), [], []
            for at, words in word_hashes(batch.column(1).to_pylist()):
                tokens = distinct(shingles(words, SHINGLE_WORDS))
                if not len(tokens) or set_id(tokens) != sids[at]:
                    continue
                rank = shared.value[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
                n = len(tokens)
                first = np.argsort(rank, kind="stable")[:n + 1 + -percent * n // 100]
                keep.append(at)
                sets.append(tokens[first].view(np.int64))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column("sid"), own.column("grp"), pa.array(sets, pa.list_(pa.int64()))], ["sid", "grp", "tokens"])

    return materialize(_of(docs, wanted, "grp").mapInArrow(tidied(read), "sid long, grp long, tokens array<long>"), "prefixes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) of which the token sets are similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(unpacked(x), unpacked(y), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # only the sets move that have to meet: those of the first sides, and those of the second
    pairs = bounded(pairs)
    left = sets.withColumnRenamed("sid", "a").join(pairs, "a").select("a", "b", F.col("tokens").alias("x"))
    ends = pairs.select(F.col("b").alias("sid")).distinct()
    right = sets.join(bounded(materialize(ends, "ends")), "sid", "left_semi").select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(tidied(test), "a long, b long")


def _within(a: str, b: str, percent: int) -> str:
    return f"100 * {a} >= {percent} * {b} AND 100 * {b} >= {percent} * {a}"


def central_pairs(classes: DataFrame) -> DataFrame:
    """(a, n, b, m, met): each class with the most central of those that share a minimum hash with it, itself perhaps.

    Copies of a text with different changes resemble the text more than each other.
    The text shares its minimum hashes with more of them than any copy does, so the
    class that meets the most others, counted over all hashes, is the one to compare with.
    """
    keyed = classes.select("sid", "n", F.posexplode("mins").alias("k", "least"))
    # the joined sides are written first, so that a minimum hash of many classes is broadcast to them or its join split
    sizes = materialize(keyed.groupBy("k", "least").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    met = materialize(keyed.join(bounded(sizes), ["k", "least"]), "met")
    central = met.groupBy("sid").agg(F.sum("size").alias("met"))
    lead = (met.join(central, "sid").groupBy("k", "least").agg(F.max(F.struct("met", "sid", "n")).alias("lead"))
            .select("k", "least", F.col("lead.sid").alias("b"), F.col("lead.n").alias("m"), F.col("lead.met").alias("met")))
    return met.join(bounded(materialize(lead, "lead")), ["k", "least"]).select(F.col("sid").alias("a"), "n", "b", "m", "met").distinct()


def star_pairs(central: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the pairs of ``central_pairs`` that can be similar by their sizes."""
    return central.where("a <> b").where(_within("n", "m", percent)).select("a", "b")


def shared_cells(found: DataFrame, grouped: DataFrame) -> DataFrame:
    """The cells (sid, token, pos, n, grp, home) of prefixes ``found`` whose tokens classes of several groups hold.

    Nearly all cells go here, so they are moved with their class and place only.
    """
    cells = found.select("sid", "grp", F.posexplode("tokens").alias("pos", "token"))
    shared = cells.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("token")
    shared = bounded(materialize(shared, "tokens"), BROADCAST_TOKENS)
    kept = materialize(cells.select("sid", "pos", "token").join(shared, "token", "left_semi"), "cells", keep=True)
    return kept.join(bounded(grouped.select("sid", "grp", "n", "home")), "sid")


def live_cells(cells: DataFrame, turns: int = 2, percent: int = PERCENT) -> DataFrame:
    """The ``cells`` (sid, token, pos, n, grp, ...) through which a class can be similar to one of another group.

    What stands behind the first token that two sets share bounds their overlap, which
    similar sets need for their sizes. So a class whose cell comes late needs a
    small partner: the cell stays where a class of another group is at hand in the
    token, in the class's own range of sizes or a neighbouring one, that is small enough.
    A turn that leaves more than three quarters is the last.
    """
    whole = 100 + percent
    reaches = f"{whole} * (n - pos) >= {percent} * (n + least)"
    live, rows = cells, cells.count()
    for _ in range(turns):
        ranged = live.withColumn("size", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
        own = ranged.groupBy("token", "size").agg(F.min("n").alias("least"), F.min("grp").alias("low"), F.max("grp").alias("high"))
        # a token has few ranges of sizes, as they grow with the logarithm
        held = own.groupBy("token").agg(F.collect_list(F.struct("size", "least", "low", "high")).alias("held"))
        around = "filter(held, x -> abs(x.size - own.size) <= 1)"
        near = (held.select("token", "held", F.explode("held").alias("own")).withColumn("around", F.expr(around))
                .where("array_min(around.low) <> array_max(around.high)")
                .selectExpr("token", "own.size AS size", "array_min(around.least) AS least"))
        live = materialize(ranged.join(bounded(materialize(near, "tokens")), ["token", "size"])
                           .where(reaches).drop("least", "size"), "cells")
        before, rows = rows, live.count()
        if 4 * rows > 3 * before:
            break
    return live


def homes_of(central: DataFrame) -> DataFrame:
    """(sid, home): the most central class that each meets."""
    return central.groupBy(F.col("a").alias("sid")).agg(F.max(F.struct("met", "b")).alias("best")).select("sid", F.col("best.b").alias("home"))


def leading(classes: DataFrame) -> DataFrame:
    """(home, lead): the group that has most of the ``classes`` (home, grp) of a home, where they are many."""
    sizes = classes.groupBy("home", "grp").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("home").agg(F.max(F.struct("n", "grp")).alias("most"), F.sum("n").alias("n"))
    return found.where(F.col("n") > CHUNK_CLASSES).select("home", F.col("most.grp").alias("lead"))


def standing_pairs(classes: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """(a, b, g1, g2): in each large home, the classes outside the leading group with a few that stand for that group.

    Copies with many changes are often not similar to the text they come from, but to
    some other copy. So a large home becomes few groups by work in proportion to its classes.
    """
    leads = bounded(materialize(leading(classes), "leads"))
    placed = materialize(classes.join(leads, "home"), "placed")
    rank = F.row_number().over(Window.partitionBy("home").orderBy(F.xxhash64("sid", F.lit(turn)), "sid"))
    stand = placed.where("grp = lead").withColumn("rank", rank).where(F.col("rank") <= STANDING)
    stand = bounded(materialize(stand.select("home", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("grp").alias("g2")), "stand"))
    return (placed.where("grp <> lead").join(stand, "home").where(_within("n", "m", percent))
            .select(F.col("sid").alias("a"), "b", F.col("grp").alias("g1"), "g2"))


def chunked(classes: DataFrame) -> DataFrame:
    """``classes`` (sid, grp, home, more) with ``chunk``: those of one home, in chunks of bounded size, the leading group's apart."""
    placed = classes.join(bounded(materialize(leading(classes), "leads")), "home", "left").withColumn("own", F.coalesce(F.col("grp") == F.col("lead"), F.lit(False)))
    parts = placed.groupBy("home", "own").agg(F.ceil(F.count(F.lit(1)) / CHUNK_CLASSES).alias("parts"))
    parts = bounded(materialize(parts.where("parts > 1"), "parts"))
    part = F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1)))
    return placed.join(parts, ["home", "own"], "left").withColumn("chunk", F.xxhash64("home", "own", part)).drop("home", "own", "lead", "parts")


def _candidates(percent: int):
    """Pairs of classes of two chunks and different groups that can be similar by their signatures."""
    names = ("a", "b", "g1", "g2")
    schema = pa.schema([(name, pa.int64()) for name in names])

    def by_cells(table: pa.Table) -> dict[int, tuple]:
        """For each count of cells: ids, groups, sizes and signatures."""
        out: dict[int, list] = {}
        for row in zip(*(column.to_pylist() for column in table.columns[2:])):
            cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[3]), np.uint8)
            out.setdefault(len(cells), []).append((*row[:3], cells))
        return {k: (*(np.array(x, np.int64) for x in list(zip(*rows))[:3]), np.array([r[3] for r in rows])) for k, rows in out.items()}

    def folded(cells: np.ndarray, k: int) -> np.ndarray:
        """Signatures over half as many cells, if k is that."""
        cells = cells.astype(np.int32)
        return cells if cells.shape[1] == k else cells[:, :k] + cells[:, k:]

    def pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        ours, theirs = by_cells(left), by_cells(right)
        for k1, (sid1, grp1, n1, cells1) in ours.items():
            for k2 in (k1 // 2, k1, 2 * k1):
                if k2 not in theirs:
                    continue
                sid2, grp2, n2, cells2 = theirs[k2]
                x, y = folded(cells1, min(k1, k2)), folded(cells2, min(k1, k2))
                union = y.max(0)
                for i in range(len(sid1)):
                    # the union of the chunk bounds what any member can share: it is opened only if that is enough
                    if 100 * np.minimum(x[i], union).sum() < percent * n1[i]:
                        continue
                    both = np.minimum(x[i], y).sum(1)
                    near = (100 * both >= percent * (n1[i] + n2 - both)) & (grp2 != grp1[i]) & (sid2 != sid1[i])
                    found.append((np.full(near.sum(), sid1[i]), sid2[near], np.full(near.sum(), grp1[i]), grp2[near]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        if key[0].as_py() == key[1].as_py():
            # within a chunk each pair once
            once = columns[0] < columns[1]
            columns = [x[once] for x in columns]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return pairs


def _also(docs: DataFrame, sets: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sets`` with those of the ``wanted`` classes (sid) that it lacks."""
    lacking = materialize(wanted.distinct().join(sets.select("sid"), "sid", "left_anti"), "lacking")
    if lacking.isEmpty():
        return sets
    return sets.union(token_sets(docs, materialize(classes.select("sid", "one").join(bounded(lacking), "sid"), "needed")))


def _regrouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (grp, more) with the groups named anew that ``links`` (a, b) bring together."""
    merged = connected_components(links).select(F.col("node").alias("grp"), "label")
    return rows.join(bounded(merged), "grp", "left").withColumn("grp", F.coalesce("label", "grp")).drop("label")


def crossing_links(docs: DataFrame, grouped: DataFrame, sets: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(a, b): groups that similar classes link, by the token-group matrix over ``grouped`` (sid, grp, one, n, home)."""
    with released(docs.sparkSession):
        cells = shared_cells(prefixes(docs, grouped, ranks, percent), grouped)
    cells = live_cells(cells, 3, percent)
    found = []
    for turn in range(TURNS):
        pairs = materialize(standing_pairs(cells.select("sid", "grp", "n", "home").distinct(), turn, percent), "standing")
        if pairs.isEmpty():
            break
        sets = _also(docs, sets, grouped, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")))
        links = pairs.join(verified(pairs.select("a", "b"), sets, percent), ["a", "b"]).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
        links = materialize(links.distinct(), "links")
        found.append(links)
        if links.isEmpty():
            continue
        # written, as the turn reads the cells three times
        cells = live_cells(materialize(_regrouped(cells, links), "cells"), 1, percent)
    return _union([*found, _matrix_links(docs, cells, grouped, sets, percent)])


def _union(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links)


def _matrix_links(docs: DataFrame, cells: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the groups that classes with the live ``cells`` link."""
    placed = materialize(chunked(cells.select("sid", "grp", "n", "home").distinct()), "chunks")
    cells = cells.drop("grp", "n", "home").join(bounded(placed), "sid")
    # a cell of the matrix keeps the sizes and the best bound of its chunk
    whole = 100 + percent
    matrix = materialize(cells.groupBy("token", "chunk").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("grp").alias("low"), F.max("grp").alias("high"),
        F.max(F.expr(f"{whole} * (n - pos) - {percent} * n")).alias("reach")), "matrix")
    x, y = matrix.alias("x"), matrix.alias("y")
    met = (x.join(y, F.col("x.token") == F.col("y.token")).where(
        f"x.chunk < y.chunk AND 100 * x.most >= {percent} * y.least AND 100 * y.most >= {percent} * x.least "
        f"AND x.reach >= {percent} * greatest(y.least, {percent} * x.least / 100) "
        f"AND y.reach >= {percent} * greatest(x.least, {percent} * y.least / 100) "
        "AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low)")
        .select(F.col("x.chunk").alias("c1"), F.col("y.chunk").alias("c2")).distinct())
    counted = placed.groupBy("chunk").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    inside = counted.where("low <> high").select(F.col("chunk").alias("c1"), F.col("chunk").alias("c2"))
    met = materialize(met.union(inside), "met")

    # signatures bound what members share; only those that can be similar are compared
    used = materialize(met.select(F.col("c1").alias("chunk")).union(met.select("c2")).distinct(), "used")
    members = placed.join(bounded(used), "chunk", "left_semi")
    known = signatures(docs, materialize(members.select("sid").join(grouped.select("sid", "one"), "sid"), "needed"))
    members = materialize(known.join(bounded(members.select("sid", "grp", "n", "chunk")), "sid"), "members")
    met = bounded(met)
    own = ["sid", "grp", "n", "cells"]
    left = members.withColumnRenamed("chunk", "c1").join(met, "c1").select("c1", "c2", *own)
    right = members.withColumnRenamed("chunk", "c2").join(met, "c2").select("c1", "c2", *own).toDF("d1", "d2", *(f"own_{name}" for name in own))
    near = left.groupBy("c1", "c2").cogroup(right.groupBy("d1", "d2")).applyInArrow(_candidates(percent), "a long, b long, g1 long, g2 long")
    near = materialize(near, "near")
    sets = _also(docs, sets, grouped, near.select(F.col("a").alias("sid")).union(near.select("b")))
    return near.join(verified(near.select("a", "b"), sets, percent), ["a", "b"]).select(F.col("g1").alias("a"), F.col("g2").alias("b"))


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for each row of ``docs`` (doc_id, text; more columns are ignored).

    A set holds the distinct five-word shingles of the whole text, words as in
    ``common.word_hashes``; fewer words are one shingle. Null texts and those without
    words have an empty set, link with nothing and are components of their own.
    The component is named by its smallest doc_id; nulls don't count, and one of
    nulls only is null. Repeated rows give repeated results. ``text_key`` is a hash
    of the text. An empty table gives no rows.
    """
    found = materialize(features(docs), "features")
    rows = found.where("part IS NULL").drop("part", "counts")
    with released(docs.sparkSession):
        classed = materialize(_classed(docs, found, rows, percent), "classed", keep=True)
    return rows.join(classed, "sid", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _classed(docs: DataFrame, found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(sid, component_id) of the classes of ``rows``, those of the features ``found``."""
    classes = materialize(
        rows.where("sid IS NOT NULL").groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.min(F.struct("text_key", "doc_id")).alias("one"), F.any_value("n_shingles").alias("n"),
            F.any_value("mins").alias("mins")), "classes")
    central = materialize(central_pairs(classes), "central")
    stars = materialize(star_pairs(central, percent), "stars")
    active = stars.select(F.col("a").alias("sid")).union(stars.select("b")).distinct()
    sets = token_sets(docs, materialize(active.join(classes, "sid").select("sid", "one"), "active"))
    groups = connected_components(verified(stars, sets, percent))
    grouped = (classes.join(groups.withColumnRenamed("node", "sid"), "sid", "left")
               .select("sid", F.coalesce("label", "sid").alias("grp"), "rep", "one", "n"))
    grouped = grouped.join(homes_of(central), "sid", "left").withColumn("home", F.coalesce("home", "sid"))
    grouped = materialize(grouped, "groups")
    merged = connected_components(crossing_links(docs, grouped, sets, token_ranks(found), percent))
    named = grouped.join(merged.withColumnRenamed("node", "grp"), "grp", "left").select(
        "sid", "rep", F.coalesce("label", "grp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "label").select("sid", "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the near duplicates of others: of each component the document of smallest doc_id stays.

    Rows with equal doc_id and text are one document and leave one row, unless the
    text is empty. Rows with a null doc_id stay unless another document stands for them.
    """
    with released(docs.sparkSession):
        found = materialize(components(docs, percent), "components", keep=True)
    gone = found.where("component_id IS NOT NULL AND NOT component_id <=> doc_id").select("doc_id", "text_key").distinct()
    again = (found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1")
             .select("doc_id", "text_key"))
    gone, again = materialize(gone, "gone"), materialize(again, "again")

    def same(other: DataFrame):
        return docs.doc_id.eqNullSafe(other.doc_id) & (F.xxhash64(docs.text) == other.text_key)

    kept = docs.join(bounded(gone), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    others = kept.join(again, same(again), "left_anti")
    return others.unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
