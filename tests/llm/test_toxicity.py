import zlib

import numpy as np
import pytest

from pagesieve.llm import toxicity as X
from pagesieve.llm.queries import QUERIES

TEXTS = ["a quite short one", "Words, with punctuation; and Ünïcode of " + "some length " * 9, "x", "padded text of nine words is here to test"]


def loss(network, words, tokens, label):
    p = X.sigmoid(network.logits(words, tokens))
    return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())


def test_slopes_against_differences():
    network = X.Network(kind=np.float64)
    words = X.Words(TEXTS)
    tokens, _ = words.windows()
    label = (np.arange(len(tokens)) % 2).astype(float)
    slopes = network.slopes(words, tokens, label)
    rng = np.random.default_rng(0)
    for name, weight in network.w.items():
        flat, own = weight.reshape(-1), slopes[name].reshape(-1)
        spots = rng.choice(np.flatnonzero(own) if own.any() else len(own), 6)
        for i in spots:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss(network, words, tokens, label)
            flat[i] = old - 1e-6
            down = loss(network, words, tokens, label)
            flat[i] = old
            assert own[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-8), name


def test_windows_overlap_by_half_and_cover_all_words():
    for n in (1, 8, 16, 17, 24, 25, 100):
        words = X.Words(["w " * 3, " ".join(f"w{i}" for i in range(n)), "", None])
        tokens, text = words.windows()
        own = words.tokens[words.bounds[1]:words.bounds[2]].tolist()
        seen = [t for t in tokens[text == 1].tolist()]
        for k, window in enumerate(seen):
            part = own[8 * k:8 * k + 16]
            assert window == part + [words.n] * (16 - len(part))
        assert 8 * (len(seen) - 1) + 16 >= n and set(text.tolist()) == {0, 1}


def test_scores_of_batches_are_those_of_single_texts():
    network = X.Network()
    texts = [*TEXTS, None, "", " .,; ", "long " * 30_000]
    alone = np.array([network.score([t])[0] for t in texts])
    assert np.allclose(network.score(texts), alone, atol=1e-5) and (alone[4:7] == 0).all()


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op3_recurrent_toxicity"](spark, folder).collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(rows[i].score, t) for i, t in toxic.items() if rows[i].held_out]
    bad, good = [s for s, t in judged if t], [s for s, t in judged if not t]
    assert np.mean([b > g for b in bad for g in good]) > 0.85


def test_one_label_or_none(spark, docs):
    rows = docs(["a b", None, ""])
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    assert X.fit(rows, labels.limit(0)) == 0.0
    assert [r._score for r in X.scored(rows, X.fit(rows, labels)).collect()] == [float(zlib.crc32(b"0") % 4 != 2)] * 3
    assert X.scored(rows.limit(0), X.Network()).count() == 0
    assert X.scored(rows.union(rows), X.Network()).where("row IS NOT NULL").count() == 6
