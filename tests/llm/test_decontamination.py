import random
from collections import Counter

import pytest

from pagesieve.llm import decontamination as D
from pagesieve.llm.queries import QUERIES


def bag(words):
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def plain(docs, items):
    found = {}
    for d, text in docs.items():
        words = (text or "").lower().split()
        for i, item in items.items():
            other = (item or "").lower().split()
            if not words or not other:
                continue
            n, theirs = min(len(other), len(words)), bag(other)
            for s in range(len(words) - n + 1):
                own = bag(words[s:s + n])
                found[d, i] = max(found.get((d, i), 0), (own & theirs).total() / (own | theirs).total())
    return {k: v for k, v in found.items() if v >= 0.75}


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 16, 40]))) for i in range(30)}
    texts = []
    for k in range(120):
        words = items[k % 30].split()
        for _ in range(k // 40):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        filler = rng.choices(vocabulary, k=rng.choice([0, 0, 50]))
        texts.append(" ".join([*filler, *words, *filler]).upper())
    texts += [None, "", "  ", " ".join(rng.choices(vocabulary, k=3000)) + " " + items[4]]
    benchmark = spark.createDataFrame([*items.items(), (90, None), (91, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in D.matches(docs(texts), benchmark).collect()}
    expected = plain(dict(enumerate(texts)), items)
    assert len(expected) > 60
    assert found == pytest.approx(expected)
    parts = D.matches(docs(texts), benchmark, part_bytes=300)
    assert {(r.doc_id, r.item_id): r.similarity for r in parts.collect()} == pytest.approx(expected)
    kept = {r.doc_id for r in D.decontaminate(docs(texts), benchmark).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in expected}


def test_repeated_words_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def runs(n, size, word):
        return [*rng.choices(vocabulary, k=n), *[word] * size]

    items = {0: runs(120, 19, "-"), 1: runs(99, 14, "|"), 2: runs(60, 40, "_"), 3: rng.choices(vocabulary, k=113), 4: ["ha"] * 30}
    texts = [["x", *items[0][:120], *["="] * 19, "y"], [*items[1][:99], *["x"] * 14], [*items[2][:60], *["_"] * 30, *["."] * 10],
             items[3], [*items[3][:100], *["*"] * 13], ["ha"] * 100, [*["ha"] * 27, "ho"] * 2, items[0], [*items[2][20:], *items[2][:20]]]
    for k in range(40):
        words = list(items[k % 4])
        at, n = rng.randrange(len(words)), rng.randrange(3, 20)
        words[at:at + n] = [rng.choice("-|_=")] * len(words[at:at + n])
        texts.append([*rng.choices(vocabulary, k=20), *words])
    texts = [" ".join(words) for words in texts]
    items = {i: " ".join(words) for i, words in items.items()}
    benchmark = spark.createDataFrame([*items.items()], "item_id long, text string")
    expected = plain(dict(enumerate(texts)), items)
    found = {(r.doc_id, r.item_id): r.similarity for r in D.matches(docs(texts), benchmark).collect()}
    assert (0, 0) in expected and (1, 1) in expected
    assert found == pytest.approx(expected)


def test_null_and_repeated_ids(spark, docs):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item), (None, "clean"), (7, item), (7, "clean too"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {(r.doc_id, r.text) for r in D.decontaminate(table, benchmark).collect()}
    assert kept == {(None, "clean"), (7, "clean too"), (None, None)}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs(["a b c"]), none).count() == 0
    assert D.matches(docs(["a"]).limit(0), none).count() == 0
    assert D.decontaminate(docs(["a", None]), none).count() == 2


def test_query_finds_every_verbatim_item(spark, sf):
    rows = QUERIES["op10_simhash_decontamination"](spark, sf).collect()
    texts = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "}
    assert held <= {(r.doc_id, r.item_id) for r in rows}
