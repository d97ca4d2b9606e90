"""A Merkle manifest of a table: a hash for each row, a tree for each group, a root of all.

A block holds 512 consecutive nodes of a tree and keeps a level as one hex string.
Fixed-width substrings of it are the runs of eight that SQL hashes into their
parents, three levels a block; what flanks a node in its run are its siblings. The
tops of the blocks are the nodes of the next round, until one is left for each
group; the tops of the groups are the nodes of one more tree. Going down again, the
path of a block's top is joined to the block and the paths within it put before it.

Everything is SQL functions. Rows are put in order by ranges, blocks are bounded,
so a group that holds most rows is no heavier for any task than the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import bounded, materialize, numbered

FAN = 8
#: Levels that a block makes, and the nodes it holds at its lowest.
DEPTH = 3
BLOCK = FAN ** DEPTH
#: Hex digits of a node.
WIDTH = 64
RUN = FAN * WIDTH

_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its count of UTF-8 bytes, a colon and its value."""
    def spelled(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(spelled, fields)), 256)


def lower_ascii(text: Column) -> Column:
    """A text with A-Z, and nothing else, in lower case."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(text, capitals, capitals.lower())


def _parents(level: Column) -> Column:
    """The level above: each run of eight nodes hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * RUN + 1, F.lit(RUN)), 256)), "")


def _siblings(level: Column, at: Column) -> Column:
    """What stands before and after a node in its run."""
    k, first = at % FAN, F.floor(at / FAN).cast("int") * RUN + 1
    return F.struct(
        F.substring(level, first, k * WIDTH).alias("left"),
        F.substring(level, first + (k + 1) * WIDTH, (FAN - 1 - k) * WIDTH).alias("right"))


def _blocks(nodes: DataFrame, item: list[str], name: str) -> DataFrame:
    """(g, n, block, items, depth, l0, l1, l2, top) of ``nodes`` (g, n, at, node, more): n is the count of nodes of tree g."""
    grouped = nodes.groupBy("g", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", *item))).alias("items"))
    # trees of up to a block end where one node is left
    depth = reduce(lambda rest, d: F.when(F.col("n") <= FAN ** d, d).otherwise(rest), range(DEPTH - 1, -1, -1), F.lit(DEPTH))
    out = grouped.withColumn("depth", depth).withColumn(
        "l0", F.array_join(F.transform("items", lambda x: F.lower(F.hex(x["node"]))), ""))
    for d in range(1, DEPTH + 1):
        out = out.withColumn(f"l{d}", F.when(F.col("depth") >= d, _parents(F.col(f"l{d - 1}"))))
    top = F.coalesce(*(F.col(f"l{d}") for d in range(DEPTH, -1, -1)))
    return materialize(out.withColumn("top", F.unhex(top)).drop(f"l{DEPTH}"), name)


def _rounds(nodes: DataFrame, item: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, lowest first, and the tops (g, node) of the trees."""
    rounds = [_blocks(nodes, item, f"{name}-0")]
    while True:
        done = rounds[-1]
        above = done.select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("at"), F.col("top").alias("node"))
        if done.where(F.col("n") > BLOCK).isEmpty():
            return rounds, above.select("g", "node")
        rounds.append(_blocks(above, ["node"], f"{name}-{len(rounds)}"))


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each item with its path: its siblings in the block, level by level, and then the path of the block's top (g, block, path)."""
    upper = F.slice(F.array(*(_siblings(F.col(f"l{d}"), F.floor(F.col("r") / FAN ** (d - 1)).cast("int")) for d in range(1, DEPTH))),
                    F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    runs = blocks.join(above, ["g", "block"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / FAN).cast("int"))).alias("r")).select(
        "g", "depth", F.slice("items", F.col("r") * FAN + 1, F.lit(FAN)).alias("items"),
        F.substring("l0", F.col("r") * RUN + 1, F.lit(RUN)).alias("run"), F.concat(upper, "path").alias("path"))
    own = F.when(F.col("depth") > 0, F.array(_siblings(F.col("run"), F.col("k")))).otherwise(F.array().cast(_PATH))
    return runs.select("g", "depth", "run", "path", F.posexplode("items").alias("k", "item")).select(
        "g", "item.*", F.concat(own, "path").alias("path"))


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The items of the lowest round with their paths, given the paths of the trees' ``tops`` (g, path)."""
    above = tops.select("g", F.lit(0).cast("long").alias("block"), "path")
    for k, blocks in enumerate(reversed(rounds)):
        items = _down(blocks, above)
        if k < len(rounds) - 1:
            above = materialize(items.select("g", F.col("at").alias("block"), "path"), "paths")
    return items


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, later: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, later_leaf, subroot, root, path) for each row of ``docs``; other columns are ignored.

    A leaf hashes ``fields``. In each group leaves ascend by ``order`` (nulls first;
    equal ones by leaf, so repeated rows have a place each) and become one subroot;
    subroots ascend by group (null first, bytewise) and become the root. ``path``
    holds (left, right) for each level up to the root, hex digits of the siblings
    before and after; a run of one has none, and a tree of one leaf has no level.
    ``later`` gives columns another value, as found at a later time: ``later_leaf``
    is the hash then, or null where none of them has changed. Empty tables give no rows.
    """
    then = [(later or {}).get(name, F.col(name)) for name in fields]
    now = leaf_hash(*map(F.col, fields))
    changed = reduce(lambda a, b: a | b, (~column.eqNullSafe(F.col(name)) for name, column in (later or {}).items()), F.lit(False))
    leaves = materialize(docs.select(
        F.col(group).alias("grp"), F.col(order).alias("id"), F.unhex(now).alias("node"),
        F.unhex(F.when(changed, leaf_hash(*then))).alias("later"), F.monotonically_increasing_id().alias("row")), "leaves")
    ranked = numbered(leaves, ["grp", "id", "node", "row"], "ranked")
    groups = materialize(ranked.groupBy("grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    groups = materialize(numbered(groups, ["first"], "groups").withColumnRenamed("at", "g").withColumnRenamed("grp", "grp_of"), "groups")
    nodes = ranked.join(bounded(groups), F.col("grp").eqNullSafe(F.col("grp_of"))).withColumn("at", F.col("at") - F.col("first"))
    rounds, tops = _rounds(nodes.select("g", "n", "at", "node", "id", "later"), ["node", "id", "later"], "tree")
    above = tops.select(F.lit(0).cast("long").alias("g"), F.lit(groups.count()).cast("long").alias("n"), F.col("g").alias("at"), "node")
    whole, root = _rounds(above, ["node"], "root")
    subroots = materialize(
        _paths(whole, root.select("g", F.array().cast(_PATH).alias("path"))).select(F.col("at").alias("g"), "node", "path"), "subroots")
    named = bounded(materialize(
        subroots.join(groups, "g").select("g", F.col("grp_of").alias(group), F.lower(F.hex("node")).alias("subroot")), "named"))
    one = root.select(F.lower(F.hex("node"))).first()
    return _paths(rounds, subroots.select("g", "path")).join(named, "g").select(
        F.col("id").alias(order), group, F.lower(F.hex("node")).alias("leaf"), F.lower(F.hex("later")).alias("later_leaf"),
        "subroot", F.lit(one and one[0]).cast("string").alias("root"), "path")


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of all siblings of a path, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
