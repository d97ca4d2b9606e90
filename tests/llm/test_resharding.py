from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.llm import resharding as R
from pagesieve.llm.queries import QUERIES


@given(st.lists(st.integers(0, 9), min_size=1, max_size=5), st.integers(1, 5))
@settings(deadline=None)
def test_flow_moves_the_fewest_bytes(supply, shards):
    capacity = R.equal_capacities(sum(supply), shards)
    flow = R.minimum_cost_flow(supply, capacity)
    assert [sum(row) for row in flow] == supply
    assert [sum(column) for column in zip(*flow)] == capacity
    moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    # what exceeds a shard's new capacity has to leave it, and nothing else does
    assert moved == sum(max(0, s - (capacity[i] if i < shards else 0)) for i, s in enumerate(supply))


def test_flow_against_brute_force():
    supply, capacity = [3, 0, 2], [1, 3, 1]
    best = min(
        sum(f for (i, j), f in zip(product(range(3), range(3)), flow) if i != j)
        for flow in product(range(4), repeat=9)
        if [sum(flow[3 * i:3 * i + 3]) for i in range(3)] == supply and [sum(flow[j::3]) for j in range(3)] == capacity)
    flow = R.minimum_cost_flow(supply, capacity)
    assert sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j) == best
    with pytest.raises(ValueError):
        R.minimum_cost_flow([2], [1])


def check_layout(rows, sizes, shards, largest):
    assert sorted(r.doc_id for r in rows) == sorted(sizes)
    total = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        total[r.shard] += sizes[r.doc_id]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) - min(total) <= 2 * largest


def test_query_deals_out_all_documents(spark, sf):
    rows = QUERIES["op4_flow_resharding"](spark, sf).collect()
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    check_layout(rows, sizes, 16, max(sizes.values()))


@pytest.mark.parametrize("files", [1, 3, 20])
def test_only_files_that_lose_rows_are_rewritten(spark, docs, tmp_path, files):
    path = str(tmp_path / "docs")
    table = docs([None, "", *("x" * (i % 50) for i in range(500))])
    table.repartition(files).write.parquet(path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    layout = R.reshard(spark, path, 4, size)
    rows = R.read_shards(spark, layout).select("row.doc_id", "shard", "slot").collect()
    check_layout(rows, {r.doc_id: len(r.text or "") + 1 for r in table.collect()}, 4, 51)
    kept = {r.file for r in layout.kept}
    assert all(r.old == r.shard for r in layout.kept) and not kept & {r.file for r in layout.rewritten}
    assert {r.file for r in layout.rewritten if r.old == r.shard} <= {r.file for r in layout.rewritten if r.old != r.shard}
    again = R.reshard(spark, path, [20_000] * 4, size)
    assert not again.rewritten and again.moved_bytes == 0


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs(["a"]).limit(0).write.parquet(path)
    layout = R.reshard(spark, path, 4, F.octet_length("text") + 1)
    assert R.read_shards(spark, layout).count() == 0


def test_equal_rows_get_slots_of_their_own(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(1).selectExpr("7L AS doc_id", "'same' AS text", "1 AS shard", "2L AS slot", "explode(sequence(1, 200)) AS row").drop("row").write.parquet(path)
    rows = R.read_shards(spark, R.reshard(spark, path, 3, F.octet_length("text") + 1)).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 200 and rows[0].row.slot == 2
