import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from pagesieve.llm.queries import QUERIES  # noqa: E402
from test_decontamination import plain as leaks  # noqa: E402
from test_jaccard_groups import plain as near  # noqa: E402
from test_jaccard_groups import shingle_set  # noqa: E402
from test_line_dedup import plain as cut_lines  # noqa: E402
from test_packing import check_packed  # noqa: E402


def test_run_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = sorted(r.doc_id for r in QUERIES["op9_weak_label_quality"](spark, sf).collect() if r.accepted)
    cut = dict(zip(good, cut_lines([texts[i] for i in good])))
    cut = {i: t for i, t in cut.items() if t.strip() or t == texts[i]}
    groups = near(cut)
    kept = {i: cut[i] for i, (_, c) in groups.items() if c == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    held = frozenset().union(*(shingle_set(t) for t in items.values()))
    near_items = {i: t for i, t in kept.items() if shingle_set(t) & held}
    for i, _ in leaks(near_items, items):
        kept.pop(i, None)
    assert 0 < len(kept) < len(texts)
    check_packed(corpus_pipeline.run(spark, sf).collect(), kept)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "a b", None, None, None), (9_000_001, None, "en", "s", 0), (9_000_002, "", "en", "s", 0),
         (9_000_003, "word " * 50_000, "en", "s", 1), (9_000_004, "Fine words here.", None, None, None)] * 2, table.schema)
    docs = table.limit(40).union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == table.columns and done.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
