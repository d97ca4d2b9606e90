import os
import random
import re

import numpy as np
import pytest

from pagesieve.llm import common
from pagesieve.llm import jaccard_groups as J
from pagesieve.llm.components import connected_components
from pagesieve.llm.queries import QUERIES


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(5, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    holders = {}
    for i in ids:
        seen = set()
        for s in sets[i]:
            seen.update(holders.setdefault(s, []))
            holders[s].append(i)
        for j in seen:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    """Families of near copies at all distances, chains, shared passages, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = rng.choices(vocabulary, k=60)
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 80, 300]))
        for _ in range(rng.choice([1, 3, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + (passage if family % 4 == 0 else [])))
    chain = rng.choices(vocabulary, k=200)
    for step in range(15):
        chain = chain[4:] + rng.choices(vocabulary, k=8)
        texts.append("  ".join(chain).upper())
    texts += [None, "", " \n ", "one two", "One  two", "one two three", "éA É", "ÉA É", texts[0], texts[0].replace(" ", "\x0b")]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(docs, seed):
    texts = corpus(seed)
    rows = J.components(docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(dict(enumerate(texts)))


@pytest.mark.parametrize("size", [128, 3])
def test_matrix_alone_finds_every_link(docs, monkeypatch, size):
    """Without stars the matrix has to find all links, in chunks of any size."""
    monkeypatch.setattr(J, "CHUNK_CLASSES", size)
    monkeypatch.setattr(J, "star_pairs", lambda central, percent: central.select("a", "b").limit(0))
    texts = corpus(3)
    rows = J.components(docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(dict(enumerate(texts)))


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_token_group_jaccard"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(texts)


def test_one_of_each_component_stays(spark, docs):
    texts = ["a b c d e f g", "a b c d e f g", None, None, "", "x y"]
    rows = docs(texts)
    kept = J.keep_one(rows.union(rows.where("doc_id = 5"))).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4, 5] and kept[0].row is not None
    nulls = spark.createDataFrame([(None, "p q r"), (7, "p q r"), (None, "s t")], "doc_id long, text string")
    assert sorted(str(r.doc_id) + r.text for r in J.keep_one(nulls).collect()) == ["7p q r", "Nones t"]
    assert J.keep_one(rows.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_overlap():
    rng = np.random.default_rng(0)
    for n, m in ((0, 5), (7, 0), (30, 40)):
        a, b = (np.unique(rng.integers(0, 60, k)).astype(np.uint64) for k in (n, m))
        assert J.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n in (1, 40, 500):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for m in (1, n // 2 + 1, n):
            other = np.unique(np.concatenate([own[:m], rng.integers(0, 1 << 63, n, dtype=np.uint64)]))[:4 * n // 3 + 1]
            x, y = J.signature(own).astype(int), J.signature(other).astype(int)
            k = min(len(x), len(y))
            x, y = (c if len(c) == k else c[:k] + c[k:] for c in (x, y))
            assert np.minimum(x, y).sum() >= J.overlap(own, other)


def test_rows_with_null_or_repeated_ids_are_read_once(spark):
    rows = [(None if i % 2 else 7, " ".join(f"w{i * 7 + k}" for k in range(9))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = J.features(table).where("part IS NULL")
    classes = found.groupBy("sid").agg(J.F.min(J.F.struct("text_key", "doc_id")).alias("one"))
    assert J._of(table, classes).count() == 60
    assert {r.component_id for r in J.components(table).collect()} == {None, 7}


def test_counting_tokens_takes_no_second_table_of_counters(docs):
    import tracemalloc

    class Plan:
        """Catches the function that Spark would run over batches."""

        def select(self, *columns):
            return self

        def mapInArrow(self, read, schema):
            self.read = read
            return self

    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(9999)) for _ in range(3000)) for _ in range(8)]
    docs(texts)  # column expressions need a session
    read = J.features(Plan()).read
    batch = J.pa.RecordBatch.from_arrays([J.pa.array(range(8)), J.pa.array(range(8)), J.pa.array(texts)], ["doc_id", "text_key", "text"])
    tracemalloc.start()
    rows, counts = read([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * 4 * J.COUNTERS
    unpack = J.zstandard.ZstdDecompressor().decompress
    total = np.concatenate([np.frombuffer(unpack(x.as_py()), "<u4") for x in counts.column("counts")])
    assert len(total) == J.COUNTERS and total.sum() == sum(x.as_py() for x in rows.column("n_shingles"))


def test_tables_of_the_work_are_removed(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark, name: f"{tmp_path}/pagesieve-{name}-{os.urandom(8).hex()}")
    texts = corpus(4)[:60]
    rows = J.components(docs(texts))
    assert sorted(path.name.split("-")[1] for path in tmp_path.glob("pagesieve-*")) == ["classed", "features"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == plain(dict(enumerate(texts)))


def test_released_removes_what_is_not_kept(spark):
    with common.released(spark):
        with pytest.raises(ValueError), common.released(spark):
            tables = common.materialize(spark.range(3), "inner"), common.materialize(spark.range(4), "kept", keep=True)
            inner, kept = (re.sub("^file:(//)?", "", table.inputFiles()[0]) for table in tables)
            assert os.path.exists(inner) and os.path.exists(kept)
            raise ValueError
        assert not os.path.exists(inner) and tables[1].count() == 4
    assert not os.path.exists(kept)
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"


def test_cells_are_grouped_anew_once_a_turn(docs, monkeypatch):
    """A turn reads the cells several times; joining them with their groups each time multiplies that join's rows."""
    written, given = [], []
    materialize, live_cells = J.materialize, J.live_cells

    def keeps(df, name, **more):
        written.append(materialize(df, name, **more))
        return written[-1]

    def lives(cells, turns, percent):
        given.append((turns, any(cells is table for table in written)))
        return live_cells(cells, turns, percent)

    monkeypatch.setattr(J, "materialize", keeps)
    monkeypatch.setattr(J, "live_cells", lives)
    monkeypatch.setattr(J, "CHUNK_CLASSES", 3)
    monkeypatch.setattr(J, "star_pairs", lambda central, percent: central.select("a", "b").limit(0))
    texts = corpus(3)
    rows = J.components(docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(dict(enumerate(texts)))
    again = [one for turns, one in given if turns == 1]
    assert again and all(again)
