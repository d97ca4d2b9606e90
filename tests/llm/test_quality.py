import zlib

from pagesieve.llm import quality as Q
from pagesieve.llm.queries import QUERIES


def test_posterior_separates_two_classes():
    good, bad = "1" * 7, "0021211"
    counts = {int(good, 3): 900, int("0" + "1" * 6, 3): 3, int(bad, 3): 80, int("1100221", 3): 20}
    posterior = Q.expectation_maximisation(counts)
    assert posterior[int(good, 3)] > 0.99 and posterior[int(bad, 3)] < 0.01 and posterior[int("1100221", 3)] < 0.5
    assert Q.expectation_maximisation({}) == {}


def test_scores_of_batches_are_those_of_single_texts():
    texts = ["A word and a word.", None, "", "### @@@", "one " * 50_000, "Ünï çôdé  x"]
    weights = Q.train([t for t in texts if t], Q.np.array([1.0, 0, 0, 1]))
    alone = [Q.scores([t], weights)[0] for t in texts]
    assert Q.np.allclose(Q.scores(texts, weights), alone) and alone[1] == alone[2] == 0


def test_query_agrees_with_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op9_weak_label_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found.values())
    right = [found[r.doc_id].accepted == (r.quality == 1) for r in labels]
    assert sum(right) / len(right) > 0.97
    clean = [found[r.doc_id].accepted for r in labels if r.quality == 1]
    assert sum(clean) / len(clean) > 0.98


def test_rows_and_columns_stay(spark, docs):
    texts = ["This is a fine sentence about the sea and the land.", "This is a fine sentence about the sea and the land.",
             None, "", "  \n", "%%% $$$ ### *** &&& %%% $$$ ### *** &&&"]
    kept = Q.keep_good(docs(texts)).collect()
    assert [r.doc_id for r in kept] == [0, 1] and kept[0].row == 0
    assert Q.judge(docs(texts)).count() == 6
    assert Q.keep_good(docs(texts).limit(0)).count() == 0
