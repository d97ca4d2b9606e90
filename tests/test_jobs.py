import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.operators import aggregate as A
from pagesieve.operators import enrich as J
from pagesieve.operators import extract as E
from pagesieve.operators import store as S
from pagesieve.plans.scans import full_scan, passive_scan, rebuild
from pagesieve.sources import layout
from pagesieve.sources import pages as P
from pagesieve.sources import sinks as K
from pagesieve.streaming import jobs

PAGES = "page_id long, url string, html string"
FETCHED = "url string, method string, status int, content_type string, content_length long, body string"


def fetched(spark, rows):
    return spark.createDataFrame([(u, "GET", s, t, n, b) for u, s, t, n, b in rows], FETCHED)


HTML = """<html><head><title>a <script>no</script></title><script>one()</script>
<!-- <script>gone()</script> --><SCRIPT src='/x.js?a=1&amp;b=2'></SCRIPT ><script src="">two()</script>
<script data-src="q" async>three("</p>")</script><style>.x{content:"<script>"}</style><script type="a>b" src=lib/y.js></script>
<script>open-ended"""


def test_sources_of_a_page(spark):
    pages = spark.createDataFrame([(1, "https://e.com/d/p.html", HTML)], PAGES)

    def named(mode):
        return {r.source: r.content for r in P.extract_sources(pages, mode).collect()}

    passive, full = named(P.PASSIVE), named(P.FULL)
    assert passive["HTML Document"] == HTML
    assert [passive.get(f"Inline Script #{i}") for i in range(1, 6)] == [
        "one()", "two()", 'three("</p>")', "open-ended", None]
    assert [full.get(f"Inline Script #{i}") for i in range(1, 5)] == ["one()", 'three("</p>")', "open-ended", None]
    assert full["Main HTML Document"] == "<!DOCTYPE html>\n" + HTML
    refs = [r.script_url for r in P.script_refs(pages).orderBy("ref_ord").collect()]
    assert refs == ["https://e.com/x.js?a=1&b=2", "https://e.com/d/lib/y.js"]


def test_base_href_moves_script_references(spark):
    pages = spark.createDataFrame([(1, "https://e.com/p", '<base href="/cdn/"><script src=a.js></script>')], PAGES)
    assert [r.script_url for r in P.script_refs(pages).collect()] == ["https://e.com/cdn/a.js"]


def test_exclusions(spark):
    urls = ["https://a.com/Admin", "https://b.com/x1", "https://c.com/", None]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)

    def kept(*lines):
        return {r.page_id for r in P.exclude_urls(pages, lines).collect()}

    assert kept("ADMIN", "", "  ") == {1, 2, 3}
    assert kept("/x\\d$/") == {0, 2, 3}
    assert kept("/admin/") == {0, 1, 2, 3}
    assert kept("/(/") == {0, 1, 2, 3}
    assert kept(" a.com") == {0, 1, 2, 3}


def test_two_files_with_one_secret_share_a_key(texts):
    rule = R.Rule("demo", R.SECRETS, r"key_\w+", "g", 0)
    found = E.occurrences(texts(["a key_12 b", "key_12"]), [rule]).withColumn("page_id", F.lit(1))
    (row,) = A.group_findings(found).collect()
    assert row.display_key == "key_12" and [o.source for o in row.occurrences] == [
        "https://cdn.example.com/0.js", "https://cdn.example.com/1.js"]


def test_endpoint_validity_and_methods(texts):
    found = E.endpoints(texts(['a="/"; b=\'/x/y?z\'; c="//cdn"; api.patch("/u")', 'fetch("/f", {method: \'put\'})']))
    keys = sorted((r.page_id, r.display_key, r.http_method) for r in found.collect())
    assert keys == [(0, "/u", None), (0, "/x/y?z", None), (0, "[PATCH] /u", "PATCH"), (1, "/f", None), (1, "[PUT] /f", "PUT")]


def test_subdomains_of_an_address_are_none(texts):
    assert E.subdomains(texts(["x.shop.example.com"], url="http://10.0.0.1/")).count() == 0


def test_sinks_and_parameters(texts):
    sources = texts(["el.innerHTML = 1; eval(x); a.href= 2"])
    assert {r.display_key for r in E.dom_sinks(sources).collect()} == {"innerHTML", "href"}
    assert {r.display_key for r in E.dom_sinks(sources, "all").collect()} == {"innerHTML", "href", "eval"}
    assert E.interesting_parameters(texts(["?id=1"]), ()).count() == 0
    assert [r.display_key for r in E.interesting_parameters(texts(["?id=1&Token :x"])).collect()] == ["id", "Token"]


NEXT = '<script id="__NEXT_DATA__" type="application/json">%s</script>'


@pytest.mark.parametrize("data, want", [
    ('{ "buildId": "b1" }', "https://e.com/_next/static/b1/_buildManifest.js"),
    ('{ "buildId": "b1", "assetPrefix": "https://cdn.e.com/" }', "https://cdn.e.com/_next/static/b1/_buildManifest.js"),
    ('{ "buildId": "b1", "assetPrefix": null }', "https://e.com/_next/static/b1/_buildManifest.js"),
    ('{ "buildId": "b1", "assetPrefix": 5 }', None),
    ('{ "buildId": "x", }', None), ('{ "props": {} }', None), ('{ "buildId": 12345 }', None), ('{ "buildId": "" }', None),
])
def test_next_manifest(spark, data, want):
    pages = spark.createDataFrame([(1, "https://e.com/path/page", "<p>" + NEXT % data)], PAGES)
    assert [r.manifest_url for r in J.next_manifests(pages).collect()] == ([want] if want else [])


def test_probe_rules(spark):
    rows = [("ok", 200, "application/json", 1000), ("nolen", 200, None, None), ("zero", 200, "text/plain", 0),
            ("html", 200, "Text/HTML", 1000), ("short", 200, None, 49), ("long", 200, None, 52428801), ("gone", 404, None, 100),
            ("moved", 204, None, 100)]
    answers = fetched(spark, [(u, s, t, n, None) for u, s, t, n in rows])
    guesses = answers.select(F.lit(1).alias("page_id"), F.col("url").alias("map_url"))
    assert {r.map_url for r in J.validate_maps(guesses, answers).collect()} == {"ok", "nolen", "zero"}


def test_rebuild_sources(spark):
    base = "https://e.com/m/"
    good = json.dumps({"sources": ["a.js", "b.js", "c.js", "d.js", "webpack:///e.js", "a.js"],
                       "sourcesContent": ["old", None, "", None, None, "new"]})
    answers = fetched(spark, [
        (base + "1.map", 200, None, None, good), (base + "b.js", 200, None, None, "B"), (base + "c.js", 404, None, None, "x"),
        (base + "2.map", 404, None, None, "x"), (base + "3.map", 200, None, None, "{bad"), (base + "4.map", 200, None, None, "{}")])
    maps = spark.createDataFrame([(f"{base}{i}.map",) for i in range(1, 6)], "map_url string")
    job = rebuild(maps, answers)
    files = {(r.map_url[-5], r.source_path): (r.content, r.origin) for r in job.files.collect()}
    assert files == {
        ("1", "a.js"): ("new", "embedded"), ("1", "b.js"): ("B", "fetched"),
        ("1", "c.js"): (f"Skipping missing source file: {base}c.js (Status: 404)", "missing"),
        ("2", J.ERROR_PATH): ("Error: HTTP status 404", "error"),
        ("3", J.ERROR_PATH): ("Error: the source map is invalid or lists no sources", "error"),
        ("4", J.ERROR_PATH): ("Error: the source map is invalid or lists no sources", "error"),
        ("5", J.ERROR_PATH): ("Error: the source map was not fetched", "error")}
    (dump,) = job.dumps.collect()
    assert json.loads(dump.dump)["metadata"]["fileCount"] == 3 and dump.dump_name == "1.map-dump.json"


def test_tree_puts_folders_first(spark):
    paths = ["z-file.js", "a-folder/a.js", "c-file.js", "b-folder/b.js"]
    tree = J.source_tree(spark.createDataFrame([("m", p) for p in paths], "map_url string, source_path string"))
    top = [r.name for r in tree.where("depth = 1").orderBy("position").collect()]
    assert top == ["a-folder", "b-folder", "c-file.js", "z-file.js"]


def test_debounce_by_brute_force_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1, 0, 59, 59)
    rows, by_tab = [], {}
    for i in range(400):
        ts = start + timedelta(milliseconds=rng.choice((100, 50)) * rng.randint(0, 900))
        tab = rng.choice((1, 1, 1, 2))
        rows.append((i, ts, tab))
        by_tab.setdefault(tab, []).append((ts, i))
    want = set()
    for events in by_tab.values():
        events.sort()
        for (ts, i), after in zip(events, events[1:] + [None]):
            if after is None or after[0] - ts >= timedelta(milliseconds=100):
                want.add(i)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, tab_id long")
    assert {r.event_id for r in S.debounce(events).collect()} == want

    late = spark.createDataFrame([(9999, start + timedelta(days=1), 99)], events.schema)
    events.unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.debounce_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
     .trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination())
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} - {9999} == want


def test_store_life_cycle(spark):
    schema = "key string, url string, status string, n_findings long, timestamp_ms long, error string"
    rows = [("passive_scan|a", "a", "complete", 1, 1000, None), ("passive_scan|b", "b", "complete", 0, None, None),
            ("7|old", "old", "complete", 0, 5000, None), ("scan_cache_c", "c", "complete", 0, 1000, None)]
    store = spark.createDataFrame(rows, schema)
    assert {r.url for r in S.expire_results(store, 3000, 2000).collect()} == {"a", "b", "old", "c"}
    assert {r.url for r in S.expire_results(store, 3001, 2000).collect()} == {"b", "old", "c"}
    assert {r.url for r in S.read_results(store, 3000, 2000).collect()} == {"a", "c", "old"}
    assert {(r.url, r.timestamp_ms) for r in S.migrate_store(store, 9).collect()} == {("a", 1000), ("b", 9), ("c", 1000)}
    batch = spark.createDataFrame([
        ("passive_scan|a", "a", "scanning", 0, 2000, None), ("passive_scan|a", "a", "complete", 4, 2000, None),
        ("scan_cache_c", "c", "failed", 0, 2000, None), ("passive_scan|b", "b", "complete", 2, 1, None)], schema)
    assert {(r.url, r.n_findings) for r in S.upsert_results(store, batch).collect()} == {("a", 4), ("b", 2), ("old", 0)}
    pages = spark.createDataFrame([(1, "https://a"), (1, "https://a"), (2, "https://b"), (1, "ftp://c")], "tab_id long, url string")
    done = spark.createDataFrame([("https://b", "complete"), ("https://a", "scanning")], "url string, status string")
    assert [tuple(r) for r in S.skip_scanned(pages, done).collect()] == [(1, "https://a")]
    assert S.skip_scanned(pages, done, force=True).count() == 3


def test_cancelled_and_evicted_tabs(spark):
    t = [datetime(2024, 1, 1, h) for h in range(6)]
    scans = spark.createDataFrame([(1, t[0], t[2]), (2, t[0], t[1]), (3, t[0], t[1])],
                                  "tab_id long, started_at timestamp, finished_at timestamp")
    closed = spark.createDataFrame([(1, t[1]), (2, t[3])], "tab_id long, closed_at timestamp")
    assert {r.tab_id for r in S.drop_cancelled(scans, closed).collect()} == {2, 3}
    keys = spark.createDataFrame([("1|u",), ("11|u",), ("2|v",)], "key string")
    assert {r.key for r in S.evict_tab(keys, closed).collect()} == {"11|u"}


def test_budget_drops_texts_of_large_pages_only(texts, spark):
    sources = texts(["x" * 100, "y" * 5])
    found = E.endpoints(texts(['"/a"', '"/b"']))
    out = {r.page_id: (r.content, r.error) for r in S.apply_budget(sources, found, 400).collect()}
    assert out == {0: ("x" * 100, None), 1: ("y" * 5, None)}
    out = {r.page_id: r.error for r in S.apply_budget(sources, found, 330).collect()}
    assert out == {0: S.QUOTA_EXCEEDED, 1: None}


PAGE = """<html><script src="/js/app.js"></script><script src="/js/app.js"></script><script>api.get("/inline")</script>
%s</html>""" % (NEXT % '{"buildId":"b1"}')
APP = 'import x from "@corp/kit"; import y from "@corp/pub"; go("https://cdn.e.com/z"); client.post("/app");'


def corpus(spark, n=3):
    pages = spark.createDataFrame([(i, f"https://e.com/p{i}", PAGE) for i in range(n)], PAGES)
    answers = fetched(spark, [
        ("https://e.com/js/app.js", 200, "text/javascript", None, APP),
        ("https://e.com/js/app.js.map", 200, "application/json", 900, "{}"),
        ("https://e.com/_next/static/b1/_buildManifest.js", 200, None, None, '{"/r1":[],"/_app":[],"/inline":[]}')])
    return pages, answers


def test_full_scan_of_a_corpus(spark):
    pages, answers = corpus(spark)
    registry = spark.createDataFrame([("@corp/kit", 404), ("@corp/pub", 200)], "package string, status int")
    job = full_scan(pages, answers, registry, guess_source_maps=True)
    found = {(r.page_id, r.category, r.display_key) for r in job.occurrences.collect()}
    for page in range(3):
        keys = {(c, k) for p, c, k in found if p == page}
        assert {("Endpoints", "[GET] /inline"), ("Endpoints", "/inline"), ("Endpoints", "[POST] /app"), ("Endpoints", "/r1"),
                ("Subdomains", "cdn.e.com"), ("Source Maps", "https://e.com/js/app.js.map"),
                ("Dependency Confusion", "@corp/kit")} <= keys
        assert not {k for c, k in keys if c == R.NPM_PACKAGES or k in ("@corp/pub", "/_app")}
    reports = job.reports.collect()
    assert len(reports) == 3
    report = json.loads(reports[0].report)
    assert "/r1" in report["findings"]["Endpoints"] and "https://e.com/js/app.js" in report["sources"]
    manifest = "https://e.com/_next/static/b1/_buildManifest.js"
    assert set(report["findings"]["External Scripts"]) == {"https://e.com/js/app.js", manifest}
    assert report["findings"]["Inline Scripts"] == {"Inline Script #1": [], "Inline Script #2": []}
    assert manifest in report["sources"]


def test_scripts_scanned_once_give_what_attached_copies_give(spark, texts):
    pages, answers = corpus(spark)
    refs = P.script_refs(pages)
    rules = R.full_rules()
    attached = P.decode_sources(P.drop_too_large(P.attach_scripts(
        P.extract_sources(pages, P.FULL).where("kind = 'external'"), refs, answers)))
    columns = E.occurrences(attached, rules).columns
    a = sorted(map(str, E.occurrences(attached, rules).select(*columns).collect()))
    b = sorted(map(str, E.script_occurrences(refs, answers, rules).select(*columns).collect()))
    assert a == b and len(a) == 3 * 2 * 5


def test_passive_scan_counts_rows(spark):
    token = "ghp_" + "".join(random.Random(1).choices("ABCdef0123456789ghiJKL", k=36))
    html = f'<html><script>k="{token}"</script></html>'
    pages = spark.createDataFrame([(1, "https://e.com/", html), (2, "https://e.com/2", "<p>"), (3, "ftp://x", html)], PAGES)
    job = passive_scan(pages)
    assert {(r.page_id, r.n_findings, r.status) for r in job.status.collect()} == {(1, 2, "found"), (2, 0, "clean")}
    assert {(r.source, r.page_id) for r in job.retained.collect()} == {("HTML Document", 1), ("Inline Script #1", 1)}
    assert passive_scan(pages, excluded_rule_ids=["github-pat"]).findings.count() == 0


def test_hot_groups_are_cut_into_parts_and_stay_whole(spark, texts):
    found = E.endpoints(texts(['"/a" ' * 1000 + '"/b"'])).withColumn("page_id", F.lit(1))
    grouped = A.group_findings(found, per_part=100).collect()
    hot = [r for r in grouped if r.display_key == "/a"]
    assert len(hot) > 5 and sum(len(r.occurrences) for r in hot) == 1000
    assert len([r for r in grouped if r.display_key == "/b"]) == 1


def test_reports_of_a_hot_page_add_up(spark, texts, monkeypatch):
    monkeypatch.setattr(K, "OCCURRENCES_PER_REPORT", 10)
    found = E.endpoints(texts([" ".join(f'"/k{i}"' for i in range(95))])).withColumn("page_id", F.lit(1))
    pages = spark.createDataFrame([(1, "https://e.com/", ""), (2, "https://e.com/2", "")], PAGES)
    rows = K.page_reports(pages, found, texts([]).select("page_id", "source", "content")).collect()
    keys = [k for r in rows if r.page_id == 1 for k in json.loads(r.report)["findings"].get("Endpoints", {})]
    assert sorted(keys) == sorted(f"/k{i}" for i in range(95))
    assert json.loads([r for r in rows if r.page_id == 2][0].report) == {"findings": {}, "sources": {}}


def test_findings_table_keeps_no_secret(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s" * 20)], "page_id long, secret string")
    K.write_findings(rows, f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    assert "secret" not in stored.columns and stored.first().secret_hint == "ssss..."


def test_jobs_walk_their_pages_once(spark, tmp_path, monkeypatch):
    """What a job returns reads no page again but for its id and URL, and looks for no tag."""
    from pagesieve.sources import addressed

    pages, answers = corpus(spark)
    pages.write.parquet(f"{tmp_path}/pages")
    pages, walks = spark.read.parquet(f"{tmp_path}/pages"), []
    parse = addressed.parse_pages
    monkeypatch.setattr(addressed, "parse_pages", lambda *a, **k: walks.append(1) or parse(*a, **k))
    passive = passive_scan(pages, answers)
    full = full_scan(pages, answers, spark.createDataFrame([("@corp/kit", 404)], "package string, status int"), guess_source_maps=True)
    assert len(walks) == 2
    for frame in (passive.findings, passive.sources, passive.status, passive.retained, full.sources, full.occurrences, full.reports):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "html:string" not in plan and "<script(?=" not in plan


def test_equal_scripts_are_kept_and_scanned_once(spark):
    from pagesieve.sources.addressed import address

    pages, answers = corpus(spark, 5)
    again = answers.unionByName(answers.withColumn("url", F.concat(F.lit("https://e.com/js/../js2/"), F.substring_index("url", "/", -1))))
    held = address(pages, again)
    assert held.texts.count() == held.texts.select("content").distinct().count()
    assert held.places.count() == 5 * 4
    rows = held.sources().select("page_id", "source", "content", "n_bytes").collect()
    plain = P.size_gate(P.attach_scripts(P.extract_sources(pages), P.script_refs(pages), answers))
    assert sorted(map(str, rows)) == sorted(map(str, plain.select("page_id", "source", "content", "n_bytes").collect()))


def test_a_newer_probe_withdraws_a_guess(spark):
    rows = [("a", "HEAD", 200, 1), ("a", "HEAD", 404, 2), ("b", "HEAD", 404, 1), ("b", "HEAD", 200, 2), ("c", "GET", 200, 5), ("c", "HEAD", 404, 1), ("d", "GET", 200, 1)]
    answers = spark.createDataFrame(
        [(u, m, s, "application/json", 100, "", t) for u, m, s, t in rows],
        "url string, method string, status int, content_type string, content_length long, body string, fetched_at long")
    guesses = answers.select(F.lit(1).alias("page_id"), F.col("url").alias("map_url")).distinct()
    assert {r.map_url for r in J.validate_maps(guesses, answers).collect()} == {"b", "d"}


def test_rebuilding_spreads_rows_over_tasks_by_their_number(spark, monkeypatch):
    # many maps name one file, one map was fetched over and over, and one has more files than a dump holds
    def body(k):
        paths = [f"a/{k}-{i}.js" for i in range(30 if k == 0 else 1)]
        return json.dumps({"version": 3, "sources": [*paths, "../lib.js"], "sourcesContent": [f"code {p}" for p in paths]})

    maps = spark.createDataFrame([(f"https://x.y/m/{k}.map",) for k in range(60)] * 2, "map_url string")
    rows = [(f"https://x.y/m/{k}.map", 200, body(k)) for k in range(60)] + [("https://x.y/lib.js", 200, "lib")]
    rows += [("https://x.y/m/1.map", 200, "")] * 40 + [("https://x.y/m/2.map", 404, f"gone {i}") for i in range(40)]
    fetched = spark.createDataFrame(rows, "url string, status int, body string")
    results = []
    for limit in (layout.TASK_ROWS, 12):
        monkeypatch.setattr(layout, "TASK_ROWS", limit)
        monkeypatch.setattr(J, "TASK_ROWS", limit)
        monkeypatch.setattr(K, "FILES_PER_DUMP", 20)
        latest = P.latest_response(fetched)
        rebuilt = J.rebuild_sources(maps, fetched).localCheckpoint()
        tree, dumps = J.source_tree(rebuilt), K.source_dumps(rebuilt, F.lit("2024-01-01").cast("timestamp"))
        results.append([sorted(map(tuple, df.collect())) for df in (latest, rebuilt, tree, dumps)])
        counts = [df.rdd.getNumPartitions() for df in (latest, tree, dumps)]
    assert results[0] == results[1] and len(results[0][1]) == 60 + 29 + 60
    assert {r[2] for r in results[0][1] if r[1] == "../lib.js"} == {"lib"}
    assert sum(r[2] for r in results[0][3]) == 149 and len(results[0][3]) == 61
    # 141 answers, 298 nodes and 149 files, 12 of them a task
    assert counts == [12, 25, 13]
