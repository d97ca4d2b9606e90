import math

import numpy as np
import pytest

from pagesieve.llm import neighbours as N
from pagesieve.llm.queries import QUERIES


def plain(rows, every=20, k=20):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if i % every == 0):
        scored = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    exact, vectors = plain(rows), dict(rows)
    found = by_query(QUERIES["op2_multiprobe_neighbours"](spark, folder).collect())
    assert found.keys() == exact.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in exact[q]}) / len(exact[q]) for q in exact]
    assert sum(hits) / len(hits) >= 0.9
    for q, answers in found.items():
        assert len(answers) == 20 and sorted(answers, key=lambda a: (-a[1], a[0])) == answers
        for i, score in answers[:3]:
            assert score == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), abs=1e-12)


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(60 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [math.nan] * 4), (280, [math.inf, 0.0, 0.0, 1.0]), (300, [])]
    table = spark.createDataFrame([(i, v, 0) for i, v in [*rows, rows[0]]], "vec_id long, embedding array<double>, key int")
    found, exact = by_query(N.nearest(table).collect()), plain(rows)
    assert found.keys() == exact.keys()
    assert [i for i, _ in found[60]] == list(range(61, 81)) and [i for i, _ in found[100]] == list(range(60, 80))
    assert all(len(v) == 20 for v in found.values())


def test_equal_vectors_of_many_digits_tie(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 64)))]
    order = rng.permutation(400).tolist()
    rows = [(order[i], rows[i % 200][1]) for i in range(400)]  # two of each, at any distance in id
    found, vectors = by_query(N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), dict(rows)
    for answers in found.values():
        assert sorted(answers, key=lambda a: (-a[1], a[0])) == answers
        of = {}
        for i, score in answers:
            of.setdefault(tuple(vectors[i]), set()).add(score)
        assert all(len(scores) == 1 for scores in of.values())


def test_inner_products_do_not_depend_on_place():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 65):
        rows = rng.normal(size=(50, n))
        doubled = np.concatenate([rows[:7], rows, rows])
        query = rng.normal(size=n)
        scores = N.inner_products(doubled, query)
        assert (scores[7:57] == scores[57:]).all() and (scores[:7] == scores[7:14]).all()
        assert scores[7] == N.inner_products(rows[:1], query)[0]


def test_near_best_keeps_all_that_may_tie():
    rough = np.concatenate([np.full(50, 1.0), np.full(50, 1.0 - 1e-15), np.zeros(500)])
    assert N._near_best(rough, 10, 1.0).tolist() == list(range(100))


@pytest.mark.parametrize("vectors, queries", [(8, 4), (8, 1 << 14), (1 << 13, 2)])
def test_blocks_of_vectors_and_queries_find_the_same(spark, monkeypatch, vectors, queries):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    everything = N.Tables(hashes=2, probes=9, width=50.0)
    whole = by_query(N.nearest(table, every=5, params=everything).collect())
    monkeypatch.setattr(N, "REGION_VECTORS", vectors)
    monkeypatch.setattr(N, "REGION_QUERIES", queries)
    assert by_query(N.nearest(table, every=5, params=everything).collect()) == whole
    exact = plain(rows, every=5)
    assert {q: [i for i, _ in a] for q, a in whole.items()} == {q: [i for i, _ in a] for q, a in exact.items()}


def test_recall_where_candidates_are_few():
    """50,000 vectors in clusters: a quarter of them at most is looked at, nine tenths of the nearest are found."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 32))
    vectors = (centres[rng.integers(0, 400, 50_000)] + 0.25 * rng.normal(size=(50_000, 32))).astype(np.float64)
    params = N.fitted(vectors[:8192], len(vectors), 20, N.Tables.for_rows(len(vectors)))
    asked = np.arange(0, len(vectors), 2500)
    above, own = N.lifted(vectors, np.linalg.norm(vectors, axis=1).max()), N.lifted_queries(vectors[asked])
    seen = np.zeros((len(asked), len(vectors)), bool)
    for table in range(params.tables):
        keys = N.bucket_keys(above, table, params)
        for row, probes in zip(seen, N.probed_keys(own, table, params)):
            row |= np.isin(keys, probes)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.take_along_axis(seen, best, axis=1).mean() >= 0.9
    assert seen.mean() <= 0.25


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in v] for q, v in by_query(N.nearest(table).collect()).items()} == {0: [20, 1], 20: [0, 1]}
    assert N.nearest(table.limit(0)).count() == 0


def test_probes_start_at_the_own_bucket_and_differ():
    params = N.Tables()
    vectors = N.lifted_queries(np.random.default_rng(2).normal(size=(5, 16)))
    probes = N.probed_keys(vectors, 0, params)
    assert (probes[:, 0] == N.bucket_keys(vectors, 0, params)).all()
    assert all(len(set(p.tolist())) == params.probes for p in probes)
