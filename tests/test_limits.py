"""Inputs beyond limits that no operator has any more."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.functions.text import has_doctype
from pagesieve.operators import extract as E
from pagesieve.operators import match as M
from pagesieve.plans.scans import full_scan, passive_scan
from pagesieve.sources import pages as P
from pagesieve.streaming import jobs


def test_doctype_behind_anything_that_may_stand_there(spark):
    cases = {
        "<!DOCTYPE html>": True, "\n" * 201 + "<!doctype html>": True, "<!-- x -->\n<!-- > --> <!DOCTYPE html>": True,
        "<!-->" + "<!doctype html>": True, "<!-- <!DOCTYPE html> -->": False, "<p><!DOCTYPE html>": False, "<!doctypes>": False, "": False}
    rows = spark.createDataFrame([(k,) for k in cases], "html string").select("html", has_doctype(F.col("html")).alias("has"))
    assert {r.html: r.has for r in rows.collect()} == cases


@pytest.mark.parametrize("labels", [1, 127, 128, 20_000])
def test_host_names_of_any_number_of_labels(spark, labels):
    (rule,) = [r for r in R.full_rules() if r.category == R.SUBDOMAINS]
    texts = ["a." * labels + "com", "x " + "ab-1." * labels + "org/path end", "a..b.co", ".a.io", "-.b.com", "a.B.c1"]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string")
    found = {r.i: r.found for r in rows.select("i", F.regexp_extract_all("t", F.lit(rule.java), F.lit(1)).alias("found")).collect()}
    assert found == {i: [m.group(1) for m in re.finditer(rule.pattern, t, re.ASCII)] for i, t in enumerate(texts)}


@given(st.lists(st.sampled_from(["a", "com", "Z", "1", "-", ".", ".", "..", "_", " ", "/", "http://", "a-" * 200, "1." * 200, "é"]), max_size=14))
@settings(deadline=None, max_examples=40, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_host_names_in_runs_of_any_length(spark, parts):
    (rule,) = [r for r in R.full_rules() if r.category == R.SUBDOMAINS]
    text = "".join(parts)
    found = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(rule.java), F.lit(1)).alias("found")).first().found
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    assert [f for f in found if f] == [m.group(1) for m in re.finditer(rule.pattern, text, flags)]


@pytest.mark.parametrize("part", ["a.", "a-", "a.1.", "com-1-"])
def test_runs_without_host_names_are_read_once(spark, part):
    rows = spark.createDataFrame([(1, "https://e.com/", "s", 1, part * (5_000_000 // len(part)))],
                                 "page_id long, url string, source string, source_ord int, content string")
    start = time.time()
    E.subdomains(rows).count()
    assert time.time() - start < 15


@pytest.mark.parametrize("opener", ["<base ", "<base href=x ", "<base href='", "<script>a()</script><base"])
def test_base_elements_are_read_once(spark, opener):
    html = opener * (5_000_000 // len(opener)) + "<base href='/late/'>"
    start = time.time()
    found = spark.createDataFrame([(html,)], "html string").select(P.base_url(F.col("html"), F.lit("https://e.com/p"))).first()[0]
    assert found.startswith("https://e.com/") and time.time() - start < 15


def test_base_elements_that_count(spark):
    cases = {
        "<base href=/a/><base href=/b/>": "/a/", "<base target=x><base href='/b/'>": "/b/", "<!-- <base href=/no/> --><BASE HREF = \"/c/\" >": "/c/",
        "<title><base href=/no/></title>": "/p", "<script>'<base href=/no/>'</script>": "/p", "<basefont href=/no/>": "/p", "<base href=''>": "/p", "<base href=/no/": "/p",
        "<base data-href=/no/ href=/d/>": "/d/"}
    rows = spark.createDataFrame([(k,) for k in cases], "html string").select("html", P.base_url(F.col("html"), F.lit("https://e.com/p")).alias("base"))
    assert {r.html: r.base.removeprefix("https://e.com") for r in rows.collect()} == cases


TOKEN = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3hJ5"


def test_size_gate_reaches_external_scripts(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://e.com/", "<script src=a.js></script><script src=big.js></script>")], "page_id long, url string, html string")
    filler = "x = 1;\n" * 800_000
    fetched = spark.createDataFrame(
        [(f"https://e.com/{name}.js", "GET", 200, None, None, body) for name, body in (("a", f'k="{TOKEN}"'), ("big", f'{filler}k="{TOKEN}"'))],
        "url string, method string, status int, content_type string, content_length long, body string")
    for limit, expected in ((P.MAX_CONTENT_BYTES, {"a"}), (None, {"a", "big"})):
        sources = {r.source for r in passive_scan(pages, fetched, max_bytes=limit).findings.collect()}
        assert sources == {f"https://e.com/{name}.js" for name in expected}
        assert {r.source for r in E.script_findings(P.script_refs(pages), fetched, max_bytes=limit).collect()} == sources
        full = full_scan(pages, fetched, max_bytes=limit)
        assert {r.source for r in full.occurrences.where(F.col("category") == R.SECRETS).collect()} == sources


def scripts(spark, html):
    rows = spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")
    return [r.content for r in P.extract_sources(rows).where("kind = 'inline'").orderBy("source_ord").collect()]


def test_what_is_never_closed_runs_to_the_end(spark):
    assert scripts(spark, "<!-- open <script>ghost()</script>") == []
    assert scripts(spark, "<title>x <script>ghost()</script>") == []
    assert scripts(spark, "<!--><script>a()</script><!-- --!><script>b()</script><!-- - -->") == ["a()", "b()"]
    assert scripts(spark, "<style>p</style ><script>c()</script><titles><script>d()</script>") == ["c()", "d()"]
    assert scripts(spark, "<script>e()") == ["e()"]


@pytest.mark.parametrize("opener", ["<!-- x", "<title> <script>", "<style>", "<script ", "<!-"])
def test_openers_are_read_once(spark, opener):
    start = time.time()
    scripts(spark, "<script>a()</script>" + opener * (1_000_000 // len(opener)))
    assert time.time() - start < 20


def test_size_gate_can_be_lifted(spark):
    rows = spark.createDataFrame([("x" * 100,), ("",)], "content string")
    assert [r.is_too_large for r in P.size_gate(rows, 10).collect()] == [True, False]
    assert [r.is_too_large for r in P.size_gate(rows, None).collect()] == [False, False]
    assert P.drop_too_large(rows, None).count() == 1 and P.drop_too_large(rows, 10).count() == 0


def test_leads_wider_than_their_window_are_rejected():
    M.check_rules([R.Rule("own", R.SECRETS, "abc[0-9]{10}", word="abc")])
    with pytest.raises(ValueError, match="word lead"):
        M.check_rules([R.Rule("own", R.SECRETS, "abc[0-9]+", word="abc[0-9]{161}")])


def test_one_observation_per_url(spark):
    rows = [("u", "HEAD", 200, ""), ("u", "GET", 404, "no"), ("u", "GET", 200, "yes"), ("u", "GET", 200, "yes"), ("v", "GET", 500, None)]
    found = P.latest_response(spark.createDataFrame(rows, "url string, method string, status int, body string")).collect()
    assert sorted((r.url, r.status, r.body) for r in found) == [("u", 200, "yes"), ("v", 500, None)]


def test_streams_keep_no_secret_and_other_runs(spark, tmp_path):
    secret = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vX7zB9dF1hJ3lP5"
    for k in range(2):
        spark.createDataFrame([(k, f"https://e.com/{k}", f"<p>{secret}</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in{k}")
        run = jobs.run_scan(
            jobs.stream_pages(spark, f"{tmp_path}/in{k}"), f"{tmp_path}/findings", f"{tmp_path}/results", f"{tmp_path}/check{k}")
        run.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/findings")
    assert "secret" not in found.columns and {r.page_id for r in found.collect()} == {0, 1}
    assert {(r.url, r.n_findings > 0) for r in jobs.current_results(spark, f"{tmp_path}/results").collect()} == {
        ("https://e.com/0", True), ("https://e.com/1", True)}
