"""The kept store of results, alone and under a stream."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import store as S
from pagesieve.sources import sinks as K
from pagesieve.streaming import jobs
from pagesieve.streaming.kept import RESULTS, SLOTS, KeptStore


def table(spark, rows):
    return spark.createDataFrame([(k, f"https://{k}/", status, n, ms, None) for k, status, n, ms in rows], RESULTS)


def seen(df):
    return sorted((r.key, r.status, r.n_findings, r.timestamp_ms) for r in df.collect())


def test_batches_in_any_order_are_one_upsert(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(12)}", rng.choice(["complete", "failed", "scanning"]), rng.randrange(3), rng.choice([None, 0, 1, 2, 3]))
            for _ in range(60)]
    whole = table(spark, rows)
    store = KeptStore(spark, f"{tmp_path}/s", buckets=4)
    assert store.current().count() == 0
    order = [rows[i::6] for i in range(6)]
    rng.shuffle(order)
    for i, part in enumerate(order):
        assert store.upsert(table(spark, part), "r", i)
        assert not store.upsert(table(spark, part), "r", i) and store.manifest().version == i + 1
    assert seen(store.current()) == seen(S.upsert_results(whole, whole.limit(0)))


def test_read_cost_does_not_grow_with_batches(spark, tmp_path):
    store = KeptStore(spark, f"{tmp_path}/s", buckets=2)
    for i in range(9):
        store.upsert(table(spark, [("a", "complete", i, i), (f"b{i}", "complete", 0, 1)]))
    assert store.stored().count() == 10 and seen(store.current())[0] == ("a", "complete", 8, 8)
    assert len(store.stored().inputFiles()) == 2
    assert len(list(Path(tmp_path).glob("s/data/bucket=*/slot=*"))) <= 2 * SLOTS
    assert len(list(Path(tmp_path).glob("s/manifest/at=*"))) <= SLOTS
    manifest = store.manifest()
    (bucket,) = store.touched(table(spark, [("a", "complete", 0, 0)]), manifest)
    assert len(store.stored(manifest, [bucket]).inputFiles()) == 1
    assert KeptStore(spark, f"{tmp_path}/s", buckets=50).manifest().buckets == 2


def test_a_change_that_broke_off_is_not_seen_and_is_written_over(spark, tmp_path, monkeypatch):
    store = KeptStore(spark, f"{tmp_path}/s", buckets=1)
    store.upsert(table(spark, [("a", "complete", 1, 1)]), "r", 0)
    before = store.manifest()
    with monkeypatch.context() as m:
        m.setattr(type(before), "rows", lambda self: 1 / 0)  # data is written, the manifest is not
        with pytest.raises(ZeroDivisionError):
            store.upsert(table(spark, [("a", "complete", 2, 2), ("c", "complete", 0, 2)]), "r", 1)
    assert store.manifest() == before and seen(store.current()) == [("a", "complete", 1, 1)]
    assert store.upsert(table(spark, [("b", "complete", 3, 3)]), "r", 1)
    assert seen(store.current()) == [("a", "complete", 1, 1), ("b", "complete", 3, 3)]


def test_expiry_empties_buckets_and_rows_without_a_key_are_passed_over(spark, tmp_path):
    store = KeptStore(spark, f"{tmp_path}/s", buckets=3)
    store.upsert(table(spark, [(S.PASSIVE_PREFIX + "|a", "complete", 1, 10), ("b", "complete", 1, 10), (None, "complete", 1, 1)]))
    store.expire(2000, 1000)
    assert seen(store.current()) == [("b", "complete", 1, 10)]
    version = store.manifest().version
    store.expire(2000, 1000)
    assert store.manifest().version == version
    store.expire(2000, S.PURGE_ALL, prefix="b")
    assert store.stored().count() == 0
    store.upsert(table(spark, []))
    assert store.stored().count() == 0


SECRET = "ghp_" + "A1b2C3d4E5" * 3 + "F6g7H8"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, lang string").coalesce(1).write.mode("append").parquet(folder)


def scan(spark, tmp_path, name="c", **options):
    pages = jobs.stream_pages(spark, f"{tmp_path}/pages", files_per_batch=1)
    jobs.run_kept_scan(pages, f"{tmp_path}/found", f"{tmp_path}/store", f"{tmp_path}/{name}", **options).awaitTermination()
    # the document and its script each hold the secret
    found = spark.read.schema("page_id long").parquet(f"{tmp_path}/found")
    results = KeptStore(spark, f"{tmp_path}/store").current()
    return sorted(r.page_id for r in found.collect()), {r.url: (r.n_findings, r.timestamp_ms) for r in results.collect()}


def test_stream_scans_once_against_the_store_and_replay_changes_nothing(spark, tmp_path):
    page = f"<html><script>k = '{SECRET}'</script></html>"
    arrive(spark, f"{tmp_path}/pages", [(1, "https://a.example/", page, "en"), (2, "https://b.example/", "<p>", "en")])
    found, results = scan(spark, tmp_path)
    assert found == [1] * 2 and {u: n for u, (n, _) in results.items()} == {"https://a.example/": 2, "https://b.example/": 0}
    arrive(spark, f"{tmp_path}/pages", [(3, "https://a.example/", page, "en"), (4, "https://c.example/", page, "en")])
    found, later = scan(spark, tmp_path)
    assert found == [1] * 2 + [4] * 2 and later["https://a.example/"] == results["https://a.example/"] and later["https://c.example/"][0] == 2
    for name in ("1", ".1.crc"):  # the batch ended, but the stream did not note it
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    assert scan(spark, tmp_path) == (found, later)
    assert scan(spark, tmp_path, "other") == (found, later)
    found, stale = scan(spark, tmp_path, "late", max_age_ms=-1)
    assert found == [1] * 4 + [3] * 2 + [4] * 4 and stale.keys() == later.keys()


def test_a_repeated_run_replaces_its_findings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 20)], "page_id long, secret string").withColumn("scan_date", F.lit("2024-01-01"))
    for run in ("a", "a", "b"):
        K.write_findings(rows, f"{tmp_path}/f", run=run)
    assert sorted(r.run for r in spark.read.parquet(f"{tmp_path}/f").collect()) == ["a", "b"]


def test_a_streamed_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    arrive(spark, f"{tmp_path}/a/pages.parquet", [(1, "https://a.example/", "<p>", "en")])
    arrive(spark, f"{tmp_path}/a/pages.parquet", [(2, "https://b.example/", "<p>", "en")])
    arrive(spark, f"{tmp_path}/a/other.parquet", [(9, "https://z.example/", "<p>", "en")])
    for k, part in enumerate(sorted((tmp_path / "a" / "pages.parquet").glob("*.parquet"))):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "pages.parquet").write_bytes(part.read_bytes())

    def urls(folder):
        root = f"{tmp_path}/{folder}-out"
        pages = jobs.stream_pages(spark, f"{tmp_path}/{folder}", "pages.parquet")
        jobs.run_scan(pages, f"{root}/findings", f"{root}/results", f"{root}/check").awaitTermination()
        return [r.url for r in jobs.current_results(spark, f"{root}/results").collect()]

    assert sorted(urls("a")) == sorted(urls("b0") + urls("b1")) == ["https://a.example/", "https://b.example/"]
