import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagesieve.llm import hard_negatives as hn

ROWS = "vec_id long, label int, vector array<long>, number int, dim string"


def plain(rows, chosen, positives=5, negatives=10):
    rows = [r for r in rows if None not in (r[0], r[1], r[2]) and None not in r[2] and sum(x * x for x in r[2]) < hn.LONGEST]
    out = []
    for a in filter(lambda r: chosen(r[0]), rows):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])))
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:positives]:
            inside = [s for s in scored if s[2] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a[0], positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside)]
    return sorted(out)


def found(spark, rows, chosen, parts=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(parts)
    return sorted(map(tuple, hn.mine(table, chosen).collect()))


def vectors(seed, n, dim, top):
    draw = random.Random(seed)
    centres = [[draw.randint(-top, top) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        size = draw.random() * 2
        out.append((i, draw.randint(0, 3), [int(size * x) + draw.randint(-top // 4, top // 4) for x in draw.choice(centres)]))
    return out


def test_against_brute_force(spark, monkeypatch):
    for seed, dim, top in ((1, 3, 4), (2, 12, 200), (3, 12, 2_000_000)):
        rows = vectors(seed, 1500, dim, top)
        expected = plain(rows, lambda i: i % 50 == 0)
        assert len(expected) > 400
        assert found(spark, rows, F.col("vec_id") % 50 == 0) == expected
    # several passes and turns give the same
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "TURN", 3)
    assert found(spark, rows, F.col("vec_id") % 50 == 0) == expected


def test_edge_cases(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [6, 8]), (2, 1, [-3, -4]), (3, 2, [3, 4]), (4, 2, [3, 4]), (4, 2, [3, 4]), (5, 2, [0, 0]), (6, None, [3, 4]),
            (7, 2, None), (8, 2, [3, None]), (None, 2, [3, 4]), (9, 2, [3, 4, 5]), (10, 1, [1, 1, 1]), (20, 1, [0, 0]), (30, 3, []), (40, 4, []),
            (50, 3, []), (60, 2, [1 << 40, 1 << 40])]
    chosen = lambda i: i % 10 == 0
    assert found(spark, rows, F.col("vec_id") % 10 == 0) == plain(rows, chosen)
    # repeated anchors have their own results
    twice = rows + [(0, 1, [3, 4])]
    assert found(spark, twice, F.col("vec_id") % 10 == 0) == plain(twice, chosen)
    assert found(spark, [], F.col("vec_id") % 10 == 0) == []
    assert found(spark, rows, F.col("vec_id") < 0) == []
    # one vector of many copies, over several buckets
    same = [(i, i % 2, [3, 4]) for i in range(5000)] + [(i, i % 2, [2, 2]) for i in range(5000, 5100)]
    assert found(spark, same, F.col("vec_id") == 5000) == plain(same, lambda i: i == 5000)


def test_ranges_hold_what_reaches_the_score_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (40, 16))
    own = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 8, (4000, 16))).astype(np.int64)
    asked = (centres[rng.integers(0, 40, 50)] + rng.normal(0, 8, (50, 16))).astype(np.int64)
    order = np.argsort(-hn.lengths(own))
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    anchors = hn.Anchors(np.arange(50), np.arange(50) + 9000, labels[:50], asked, np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62))
    best, verified = hn.Best(anchors.least, anchors.most, 5), 0
    for a in range(0, 4000, 500):
        part = order[a:a + 500]
        bucket = hn.Bucket.of(ids[part], labels[part], own[part])
        every = hn.products(asked, bucket.vectors)
        reach = np.quantile(every, 0.99, axis=1)
        mask = hn.feasible(anchors, np.arange(50), reach, bucket, hn.directions(bucket.vectors))
        assert mask[every >= reach[:, None]].all() and not mask.all()
        verified += hn.search(anchors, best, bucket, True)
    best.merge()
    truth = [sorted(zip((-row).tolist(), range(4000)))[:5] for row in hn.products(asked, own)]
    assert [(-s, i) for s, i in zip(best.kept[1].tolist(), best.kept[2].tolist())] == [x for row in truth for x in row]
    assert verified < 0.8 * 50 * 4000


def test_quantised(spark):
    rows = [([0.5, -0.001],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf")],), ([],)]
    out = spark.createDataFrame(rows, "v array<float>").select(hn.quantised(F.col("v"))).collect()
    assert [r[0] for r in out] == [[128, math.floor(-0.256)], None, None, None, None, []]
