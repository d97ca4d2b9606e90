"""Named queries over the sample tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.functions import text as X
from pagesieve.functions import urls as U
from pagesieve.operators import aggregate as A
from pagesieve.operators import enrich as J
from pagesieve.operators import extract as E
from pagesieve.operators import match as M
from pagesieve.operators import store as S
from pagesieve.plans import oracle as O
from pagesieve.plans.scans import full_scan, passive_scan, rebuild
from pagesieve.session import shared_dir
from pagesieve.sources import pages as P
from pagesieve.sources import sinks as K
from pagesieve.sources.addressed import address, materialize
from pagesieve.sources.corpora import corpus
from pagesieve.sources.exclusions import exclude_by_lines
from pagesieve.sources.layout import spread
from pagesieve.streaming import jobs
from pagesieve.streaming.kept import KeptStore

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_URL_LIST = ("Example.ORG", "", "/page=[0-9]+&ref/", "/(/", "   ")
_NOW = 1700003000000
_PAGE_SOURCES = "SELECT page_id, url, 'HTML Document' AS source, 0 AS source_ord, html AS content FROM pages"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source"), F.col("text").alias("content"))


_DOCUMENTS = "SELECT doc_id AS page_id, source, text AS content FROM documents"


def _url_sources(spark: SparkSession, folder: str) -> DataFrame:
    return P.read_pages(spark, folder).select(
        "page_id", "url", F.lit("url").alias("source"), F.lit(0).alias("source_ord"), F.col("url").alias("content"))


# -- sources and scoping ------------------------------------------------------

@query("s1_read_pages", """
    SELECT page_id, url, length(html) AS n_chars, md5(html) AS html_md5,
        regexp_matches(html, '(?i)^\\s*<!doctype') AS has_doctype FROM pages""")
def _(spark, folder):
    return P.read_pages(spark, folder).select(
        "page_id", "url", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"),
        X.has_doctype(F.col("html")).alias("has_doctype"))


def _digest(sources: DataFrame) -> DataFrame:
    return sources.select(
        "page_id", "source", "kind", "source_ord", F.length("content").alias("n_chars"),
        F.md5("content").alias("content_md5"))


for _mode in (P.PASSIVE, P.FULL):
    @query(f"s2_sources_{_mode}", f"""
        SELECT page_id, source, kind, source_ord, length(content) AS n_chars, md5(content) AS content_md5
        FROM ({O.sources(O.corpus('site_pages'), _mode)})""")
    def _(spark, folder, mode=_mode):
        return _digest(P.extract_sources(corpus(spark, folder, "site_pages"), mode))


@query("s3_script_refs", f"SELECT * FROM ({O.script_refs(O.corpus('site_pages'))})")
def _(spark, folder):
    return P.script_refs(corpus(spark, folder, "site_pages"))


@query("s4_attach_scripts", f"""
    SELECT page_id, source, kind, source_ord, length(content) AS n_chars, md5(content) AS content_md5 FROM (
        {O.sources(O.corpus('site_pages'), 'passive')}
        UNION ALL SELECT r.page_id, r.url, script_url, 'external', ref_ord + {1 << 20}, body
        FROM ({O.script_refs(O.corpus('site_pages'))}) r JOIN ({O.responses('fetched_scripts')}) f ON f.url = script_url
        WHERE status BETWEEN 200 AND 299 AND body <> '')""")
def _(spark, folder):
    pages = corpus(spark, folder, "site_pages")
    return _digest(P.attach_scripts(
        P.extract_sources(pages), P.script_refs(pages), corpus(spark, folder, "fetched_scripts")))


@query("s5_size_gate", """
    SELECT page_id, n_bytes, n_bytes > 8192 AS is_too_large
    FROM (SELECT doc_id AS page_id, octet_length(encode(text)) AS n_bytes FROM documents)""")
def _(spark, folder):
    return P.size_gate(_documents(spark, folder), 8192).select("page_id", "n_bytes", "is_too_large")


_SCANNABLE = """starts_with(url, 'http') AND NOT starts_with(url, 'https://chrome.google.com/webstore')
    AND NOT starts_with(url, 'https://chromewebstore.google.com/') AND NOT starts_with(url, 'https://addons.mozilla.org')"""


@query("s6_scannable", f"SELECT event_id, url FROM ({O.corpus('nav_events')}) WHERE {_SCANNABLE}")
def _(spark, folder):
    return P.scannable(corpus(spark, folder, "nav_events")).select("event_id", "url")


@query("s7_exclude_urls", """
    SELECT page_id, url FROM pages
    WHERE NOT contains(lower(url), 'example.org') AND NOT regexp_matches(url, 'page=[0-9]+&ref')""")
def _(spark, folder):
    return P.exclude_urls(P.read_pages(spark, folder), _URL_LIST).select("page_id", "url")


_MORE_LINES = ("/[0-9]7$/", "/(/", "   ", "=3")


# A list of tens of thousands of lines: hosts made of the words of the documents, and a few others.
@query("s7_exclusion_lines", """
    WITH lines AS (SELECT DISTINCT lower(word) || '.example.' AS line
        FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) UNION ALL SELECT '=3')
    SELECT page_id, url FROM pages p
    WHERE NOT regexp_matches(url, '[0-9]7$') AND NOT EXISTS (SELECT 1 FROM lines WHERE contains(lower(p.url), line))""")
def _(spark, folder):
    words = _table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    lines = words.select(F.concat("word", F.lit(".EXAMPLE.")).alias("line")).union(
        spark.createDataFrame([(line,) for line in _MORE_LINES], "line string"))
    return exclude_by_lines(P.read_pages(spark, folder), lines).select("page_id", "url")


_OFF = ("github-pat", "databricks-api-token")


@query("s8_rule_exclusion", f"""
    SELECT page_id, id, source, line, "column"
    FROM ({O.secret_findings(O.corpus('token_scripts'), R.strict_rules(_OFF))})""")
def _(spark, folder):
    found = E.secret_findings(corpus(spark, folder, "token_scripts"), R.strict_rules(_OFF))
    return found.select("page_id", "id", "source", "line", "column")


@query("s9_main_frame", f"""
    SELECT event_id, tab_id, url FROM ({O.corpus('nav_events')}) WHERE frame_id = 0 AND {_SCANNABLE}""")
def _(spark, folder):
    return P.main_frame(corpus(spark, folder, "nav_events")).select("event_id", "tab_id", "url")


@query("s10_language", f"""
    SELECT source, CASE WHEN ends_with(source, '.js') THEN 'javascript' WHEN ends_with(source, '.css') THEN 'css'
        WHEN ends_with(source, '.json') THEN 'json'
        WHEN ends_with(source, '.html') OR source = 'HTML Document' THEN 'markup' ELSE 'javascript' END AS language
    FROM (SELECT url || (CASE page_id % 5 WHEN 0 THEN '.css' WHEN 1 THEN '.json' WHEN 2 THEN '.html'
          WHEN 3 THEN '.js' ELSE '' END) AS source FROM pages
          UNION ALL SELECT source FROM ({_PAGE_SOURCES}))""")
def _(spark, folder):
    pages = P.read_pages(spark, folder)
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".css", ".json", ".html", ".js", "")]),
                          (F.col("page_id") % 5 + 1).cast("int"))
    names = pages.select(F.concat("url", suffix).alias("source")).unionByName(
        P.extract_sources(pages).where(F.col("kind") == "html").select("source"))
    return P.label_sources(names)


# -- text functions -----------------------------------------------------------

@query("n1_decode_constructed", """
    SELECT c_custkey, '<b>' || c_name || '</b> 100% & "é" %E9 %41 A&B€ &nope; ¬it; ' || chr(10) || 'end <' || c_custkey || '>'
        AS decoded FROM customer""")
def _(spark, folder):
    encoded = F.concat(
        F.lit("%3Cb%3e"), F.regexp_replace("c_name", "#", "&num;"), F.lit("\\u003c/b> 100% &amp; &quot;&eacute;&quot; %E9 %2541"),
        F.lit(" u0041&#38;&#x42;&#128; &nope; &notit; "), F.lit("\r\nend &lt"), F.lit(";"), F.col("c_custkey").cast("string"), F.lit("&gt;"))
    return _table(spark, folder, "customer").select("c_custkey", X.decode_text(encoded).alias("decoded"))


@query("n1_decode_pages", """
    SELECT page_id, regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
        '&amp;?', '&', 'g') AS decoded FROM pages""")
def _(spark, folder):
    return P.read_pages(spark, folder).select("page_id", X.decode_text(F.col("html")).alias("decoded"))


@query("n2_resolve_url", f"""
    SELECT page_id, {O.origin('url')} || regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''),
            '[^/]*$', '') || 'x/z?q=' || page_id AS relative,
        {O.origin('url')} || '/root/' || page_id AS rooted, 'https://cdn.example.com/a' AS other,
        regexp_extract(url, '^(https?):', 1) || '://cdn.example.com/b' AS schemeless, NULL AS unsafe,
        regexp_replace(url, '#.*$', '') AS plain
    FROM pages""")
def _(spark, folder):
    def on(ref):
        return U.resolve_url(ref, F.col("url"))

    key = F.col("page_id").cast("string")
    return P.read_pages(spark, folder).select(
        "page_id", on(F.concat(F.lit("./x/y/../z?q="), key, F.lit("#f"))).alias("relative"),
        on(F.concat(F.lit("/a/../root/./"), key)).alias("rooted"),
        on(F.lit("HTTPS://CDN.example.com:443/a")).alias("other"), on(F.lit("//cdn.example.com/b")).alias("schemeless"),
        on(F.lit("javascript:alert(1)")).alias("unsafe"), U.normalize_url(F.col("url")).alias("plain"))


@query("n3_domain_info", f"""
    SELECT page_id, host, CASE WHEN {O.is_ip('host')} THEN NULL ELSE host END AS current_hostname,
        {O.base_domain('host')} AS base_domain
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN h WHEN 1 THEN '10.0.' || (page_id % 300) || '.1'
            WHEN 2 THEN h || '.co.uk' ELSE 'localhost' END AS host
          FROM (SELECT page_id, {O.host('url')} AS h FROM pages))""")
def _(spark, folder):
    h, k = U.url_host(F.col("url")), F.col("page_id")
    host = (F.when(k % 4 == 0, h).when(k % 4 == 1, F.concat(F.lit("10.0."), (k % 300).cast("string"), F.lit(".1")))
            .when(k % 4 == 2, F.concat(h, F.lit(".co.uk"))).otherwise("localhost"))
    return P.read_pages(spark, folder).select("page_id", host.alias("host")).select(
        "page_id", "host", U.current_hostname(F.col("host")).alias("current_hostname"),
        U.base_domain(F.col("host")).alias("base_domain"))


@query("n4_sanitize", """
    SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE left(text, 200) END AS id,
        CASE WHEN text = '' THEN NULL ELSE left(text, 500) END AS description, left(text, 2000) AS source,
        left(text, 10000) AS secret, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS line,
        NULL::INT AS "column", FALSE AS is_source_too_large FROM documents""")
def _(spark, folder):
    text, k = F.col("text"), F.col("doc_id")
    raw = _table(spark, folder, "documents").select(
        k.alias("page_id"), F.when(k % 3 != 0, text).alias("id"), text.alias("description"), text.alias("source"),
        text.alias("secret"), F.when(k % 2 == 0, k).otherwise(k + F.lit(0.5)).alias("line"),
        F.lit("x").alias("column"), F.lit(None).cast("boolean").alias("is_source_too_large"))
    return E.sanitize_findings(raw)


@query("n5_preview", """
    SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS preview FROM documents""")
def _(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


_BARE = [r for r in R.CATEGORY_RULES if r.rule_id == "endpoint-bare-url"]


def _page_sources(spark: SparkSession, folder: str) -> DataFrame:
    return P.read_pages(spark, folder).select(
        "page_id", "url", F.lit("HTML Document").alias("source"), F.lit(0).alias("source_ord"), F.col("html").alias("content"))


@query("n6_snippet", f"""
    SELECT page_id, "index", '... ' || replace(substring(html, greatest(0, "index" - 40) + 1,
        least(length(html), "index" + secret_length + 40) - greatest(0, "index" - 40)), chr(10), ' ') || ' ...' AS snippet
    FROM ({O.occurrences(_PAGE_SOURCES, _BARE)}) JOIN pages USING (page_id)""")
def _(spark, folder):
    sources = _page_sources(spark, folder)
    return E.with_snippet(E.occurrences(sources, _BARE), sources).select("page_id", "index", "snippet")


# -- match engine -------------------------------------------------------------

_SENTENCE = R.Rule("sentence", "Text", r"([a-z]+)[.]\s+([A-Z][a-z]+)", "g", 2)


@query("m1_m3_matches_with_position", f"""
    SELECT page_id, source, match, finding, "index", line, "column", match_ord
    FROM ({O.matches(_DOCUMENTS, [_SENTENCE])})""")
def _(spark, folder):
    return M.match_rule(_documents(spark, folder), _SENTENCE).select(
        "page_id", "source", "match", "finding", "index", "line", "column", "match_ord")


@query("m4_entropy", f"SELECT doc_id, round({O.entropy('text')}, 6) AS entropy FROM documents")
def _(spark, folder):
    return spread(_table(spark, folder, "documents"), ["doc_id"]).select(
        "doc_id", F.round(X.shannon_entropy(F.col("text")), 6).alias("entropy"))


_GENERIC = [R.rule_by_id("generic-api-key")]


@query("m4_generic_candidates", f"""
    SELECT page_id, finding, "index", line, "column", round({O.entropy('finding')}, 6) AS entropy
    FROM ({O.matches(_DOCUMENTS, _GENERIC)})""")
def _(spark, folder):
    found = M.with_entropy(M.scan(_documents(spark, folder), _GENERIC))
    return found.select("page_id", "finding", "index", "line", "column", F.round("entropy", 6).alias("entropy"))


@query("m5_entropy_filter", f"""
    SELECT page_id, finding, "index" FROM ({O.matches(O.corpus('token_scripts'), _GENERIC)})
    WHERE {O.entropy('finding')} >= entropy_floor""")
def _(spark, folder):
    found = M.entropy_filter(M.scan(corpus(spark, folder, "token_scripts"), _GENERIC))
    return found.select("page_id", "finding", "index")


_WORD = R.Rule("word", "Text", r"[A-Za-z]{6,}", "g", 0)


@query("m6_cap_matches", f"""
    SELECT page_id, match_ord, finding FROM ({O.matches(_DOCUMENTS, [_WORD])}) WHERE match_ord < 5""")
def _(spark, folder):
    return M.match_rule(_documents(spark, folder), _WORD, limit=5).select("page_id", "match_ord", "finding")



@query("m7_clean_group", f"""
    SELECT page_id, match_ord, finding FROM (
        SELECT page_id, match_ord, trim(finding, ' ' || chr(10)) AS finding FROM (
            {O.matches(_DOCUMENTS, [R.Rule('s', 'Text', r'[.]([^.A-Z]*)', 'g', 1)])})) WHERE finding <> ''""")
def _(spark, folder):
    rule = R.Rule("s", "Text", r"[.]([^.A-Z]*)", "g", 1)
    return M.clean_group(M.match_rule(_documents(spark, folder), rule)).select("page_id", "match_ord", "finding")


# -- extractors ---------------------------------------------------------------

_FINDING = ("page_id", "id", "description", "secret", "source", "is_source_too_large", "line", "column", "rule_ord", "match_ord")

for _name, _source in (("token_scripts", O.corpus("token_scripts")), ("documents", _DOCUMENTS)):
    @query(f"f1_secrets_{_name}", O.secret_findings(_source, R.strict_rules()))
    def _(spark, folder, name=_name):
        sources = _documents(spark, folder) if name == "documents" else corpus(spark, folder, name)
        return E.secret_findings(sources).select(*_FINDING)


@query("f1_secrets_conversations", O.secret_findings(
    "SELECT conv_id AS page_id, role || ' ' || turn AS source, text AS content FROM conversations", R.strict_rules()))
def _(spark, folder):
    turns = _table(spark, folder, "conversations").select(
        F.col("conv_id").alias("page_id"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("source"),
        F.col("text").alias("content"))
    return E.secret_findings(turns).select(*_FINDING)


_FULL_SECRETS = [r for r in R.full_rules() if r.category == R.SECRETS]

for _name, _corpus, _build, _rules in (
    ("f2_secrets_full", "token_scripts", E.full_secrets, _FULL_SECRETS),
    ("f3_subdomains_scripts", "web_scripts", E.subdomains, R.category_rules(R.SUBDOMAINS)),
    ("f4_f8_endpoints", "api_scripts", E.endpoints, R.category_rules(R.ENDPOINTS)),
    ("f5_endpoint_fetch", "api_scripts", lambda s: E.endpoints(s, ["endpoint-fetch-with-method"]),
     [R.rule_by_id("endpoint-fetch-with-method")]),
    ("f6_endpoint_axios", "api_scripts", lambda s: E.endpoints(s, ["endpoint-axios-method"]),
     [R.rule_by_id("endpoint-axios-method")]),
    ("f7_endpoint_client", "api_scripts", lambda s: E.endpoints(s, ["endpoint-http-method"]),
     [R.rule_by_id("endpoint-http-method")]),
    ("f8_endpoint_xhr", "api_scripts", lambda s: E.endpoints(s, ["endpoint-xhr-open"]),
     [R.rule_by_id("endpoint-xhr-open")]),
    ("f10_libraries", "map_scripts", E.libraries, R.category_rules(R.LIBRARIES)),
    ("f11_dom_sinks", "web_scripts", E.dom_sinks, R.category_rules(R.SINKS)),
    ("f12_parameters", "web_scripts", E.interesting_parameters, [R.parameter_rule(R.DEFAULT_PARAMETERS)]),
    ("f13_f14_npm_packages", "web_scripts", E.npm_packages, R.category_rules(R.NPM_PACKAGES)),
    ("f15_f17_graphql", "web_scripts", E.graphql, R.category_rules(R.GRAPHQL)),
):
    @query(_name, O.occurrences(O.corpus(_corpus), _rules))
    def _(spark, folder, name=_corpus, build=_build):
        return build(corpus(spark, folder, name))


@query("f3_subdomains_pages", O.occurrences(_PAGE_SOURCES, R.category_rules(R.SUBDOMAINS)))
def _(spark, folder):
    return E.subdomains(_page_sources(spark, folder))


@query("f4_endpoints_pages", O.occurrences(_PAGE_SOURCES, _BARE))
def _(spark, folder):
    return E.endpoints(_page_sources(spark, folder), ["endpoint-bare-url"])


@query("f9_source_maps", f"""
    SELECT page_id, display_key, "index", line, "column", CASE WHEN starts_with(display_key, 'http') THEN display_key
        WHEN starts_with(display_key, '/') THEN 'https://cdn.example.com' || display_key
        ELSE 'https://cdn.example.com/js/' || display_key END AS map_url
    FROM ({O.occurrences(O.corpus('map_scripts'), R.category_rules(R.SOURCE_MAPS))})""")
def _(spark, folder):
    return E.source_maps(corpus(spark, folder, "map_scripts")).select(
        "page_id", "display_key", "index", "line", "column", "map_url")


_ALL_SINKS = (
    r"(?:[.](?:innerHTML|outerHTML|src|href|action|style|cssText)\b\s*=|(?:[.]|\b)(?:insertAdjacentHTML|write|writeln|replace"
    r"|open|setAttribute|assign|html|append|prepend|after|before|parseHTML|eval|setTimeout|setInterval)\b\s*\()")


@query("f11_dom_sinks_all", f"""
    SELECT page_id, regexp_extract(match, '([a-zA-Z]+)', 1) AS display_key, "index", line, "column"
    FROM ({O.matches(O.corpus('web_scripts'), [R.Rule(None, R.SINKS, _ALL_SINKS, 'gi', 0)])})""")
def _(spark, folder):
    return E.dom_sinks(corpus(spark, folder, "web_scripts"), sinks="all").select(
        "page_id", "display_key", "index", "line", "column")


_URLS = "SELECT page_id, url, 'url' AS source, 0 AS source_ord, url AS content FROM pages"


@query("f12_parameters_urls", O.occurrences(_URLS, [R.parameter_rule(("page", "ref", r"q\w*"))]))
def _(spark, folder):
    return E.interesting_parameters(_url_sources(spark, folder), ("page", "ref", r"q\w*"))


_FULL_SOURCES = f"""SELECT page_id, url, source, kind, source_ord, content FROM (
    {O.sources(O.corpus('site_pages'), 'full')}
    UNION ALL SELECT r.page_id, r.url, script_url, 'external', ref_ord + {1 << 20}, body
    FROM ({O.script_refs(O.corpus('site_pages'))}) r JOIN ({O.responses('fetched_scripts')}) f ON f.url = script_url
    WHERE status BETWEEN 200 AND 299 AND body <> '')"""


def _full_sources(spark: SparkSession, folder: str) -> DataFrame:
    pages = corpus(spark, folder, "site_pages")
    return P.attach_scripts(
        P.extract_sources(pages, P.FULL), P.script_refs(pages), corpus(spark, folder, "fetched_scripts"))


@query("f18_external_scripts", f"""
    SELECT DISTINCT page_id, source FROM ({_FULL_SOURCES})
    WHERE source <> 'Main HTML Document' AND NOT starts_with(source, 'Inline Script')""")
def _(spark, folder):
    return P.external_script_inventory(_full_sources(spark, folder))


@query("f19_inline_scripts", f"SELECT page_id, source FROM ({_FULL_SOURCES}) WHERE starts_with(source, 'Inline Script')")
def _(spark, folder):
    return P.inline_script_inventory(_full_sources(spark, folder))


@query("full_scan_pages", O.occurrences(_PAGE_SOURCES, R.full_rules()))
def _(spark, folder):
    return E.occurrences(_page_sources(spark, folder), R.full_rules())


# -- jobs ---------------------------------------------------------------------

def _job_sources(mode: str, pages: str) -> str:
    return f"""{O.sources(pages, mode)}
    UNION ALL SELECT r.page_id, r.url, script_url, 'external', ref_ord + {1 << 20}, body
    FROM ({O.script_refs(pages)}) r JOIN ({O.responses('job_fetched')}) f ON f.url = script_url
    WHERE status BETWEEN 200 AND 299 AND body <> ''"""


_JOB_PAGES = O.corpus("job_pages")
_JOB_WANTED = f"SELECT * FROM ({_JOB_PAGES}) WHERE {_SCANNABLE}"
_JOB_LISTED = f"WITH listed AS MATERIALIZED ({_job_sources('passive', _JOB_WANTED)})"
_JOB_FOUND = O.secret_findings("SELECT * FROM listed", R.strict_rules())


@query("job_passive_scan", f'{_JOB_LISTED} SELECT page_id, id, secret, source, is_source_too_large, line, "column" FROM ({_JOB_FOUND})')
def _(spark, folder):
    job = passive_scan(corpus(spark, folder, "job_pages"), corpus(spark, folder, "job_fetched"))
    return job.findings.select("page_id", "id", "secret", "source", "is_source_too_large", "line", "column")


@query("job_passive_pages", f"""
    {_JOB_LISTED}, found AS MATERIALIZED (SELECT page_id, source FROM ({_JOB_FOUND}))
    SELECT page_id, url, n_findings, CASE WHEN n_findings > 0 THEN 'found' ELSE 'clean' END AS status, coalesce(n_sources, 0) AS n_sources,
        coalesce(n_chars, 0) AS n_chars
    FROM (SELECT p.page_id, p.url, count(f.source) AS n_findings FROM ({_JOB_WANTED}) p LEFT JOIN found f USING (page_id) GROUP BY ALL)
    LEFT JOIN (SELECT page_id, count(*) AS n_sources, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM listed
        WHERE CASE WHEN kind = 'external' THEN (page_id, source) IN (SELECT (page_id, source) FROM found)
            ELSE page_id IN (SELECT page_id FROM found) END GROUP BY page_id) USING (page_id)""")
def _(spark, folder):
    job = passive_scan(corpus(spark, folder, "job_pages"), corpus(spark, folder, "job_fetched"))
    kept = job.retained.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(F.length("content")).alias("n_chars"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_chars")]
    return job.status.join(kept, "page_id", "left").select("page_id", "url", "n_findings", "status", *counts)


_JOB_DECODED = f"""SELECT * REPLACE (regexp_replace(regexp_replace(replace(replace(replace(content, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
    '&amp;?', '&', 'g'), '(?:\\\\u0067|%67|&#103;)hp_', 'ghp_', 'g') AS content) FROM ({_job_sources("full", _JOB_PAGES)}) WHERE content <> ''"""
_JOB_MANIFESTS = f"""SELECT page_id, 'https://cdn.example.com/_next/static/b' || (page_id % 10) || '/_buildManifest.js' AS manifest_url
    FROM pages WHERE page_id % 6 = 1"""
_JOB_ROUTES = f"""SELECT DISTINCT manifest_url, unnest(regexp_extract_all(body, '"(/[^"]*)"[ ]*:', 1)) AS route
    FROM ({O.responses('job_fetched')}) f JOIN ({_JOB_MANIFESTS}) m ON f.url = m.manifest_url WHERE status = 200"""


@query("job_full_scan", f"""
    WITH decoded AS MATERIALIZED ({_JOB_DECODED}),
    found AS MATERIALIZED (SELECT page_id, category, display_key, source, rule_id, "index", secret_length, line, "column"
        FROM ({O.occurrences("SELECT * FROM decoded", R.full_rules())}))
    SELECT * FROM found WHERE category <> '{R.NPM_PACKAGES}'
    UNION ALL SELECT * REPLACE ('Dependency Confusion' AS category) FROM found WHERE category = '{R.NPM_PACKAGES}'
        AND display_key IN (SELECT package FROM ({O.corpus('job_registry')}) WHERE status = 404)
    UNION ALL SELECT DISTINCT r.page_id, 'Source Maps', f.url, 'Heuristic (Guessed)', 'guessed-source-map', 0, 0, 0, 0
        FROM ({O.script_refs(_JOB_PAGES)}) r JOIN ({O.responses('job_fetched', 'HEAD')}) f ON f.url = script_url || '.map'
    UNION ALL SELECT DISTINCT m.page_id, 'Endpoints', route, manifest_url, NULL, 0, NULL, 1, 1
        FROM ({_JOB_MANIFESTS}) m JOIN ({_JOB_ROUTES}) r USING (manifest_url)
        WHERE NOT starts_with(route, '/_') AND NOT contains(route, '[...')
            AND NOT EXISTS (SELECT 1 FROM found e WHERE e.category = 'Endpoints' AND e.page_id = m.page_id AND e.display_key = route)""")
def _(spark, folder):
    job = full_scan(corpus(spark, folder, "job_pages"), corpus(spark, folder, "job_fetched"), corpus(spark, folder, "job_registry"),
                    guess_source_maps=True)
    return job.occurrences.select("page_id", "category", "display_key", "source", "rule_id", "index", "secret_length", "line", "column")


@query("job_rebuild", f"""
    WITH maps AS (SELECT DISTINCT script_url || '.map' AS map_url, page_id % 7 AS k FROM ({O.script_refs(_JOB_PAGES)})
        WHERE contains(script_url, '/static/app') AND page_id % 7 NOT IN (3, 5))
    SELECT map_url, 'src/a.js' AS source_path, 'code ' || k AS content, 'embedded' AS origin FROM maps WHERE k < 3
    UNION ALL SELECT map_url, 'rebuild.error.log', 'Error: the source map was not fetched', 'error' FROM maps WHERE k >= 3""")
def _(spark, folder):
    fetched = corpus(spark, folder, "job_fetched")
    held = address(corpus(spark, folder, "job_pages"), fetched, P.FULL)
    named = E.with_map_urls(E.addressed_occurrences(held, R.category_rules(R.SOURCE_MAPS)))
    return rebuild(named.select("map_url"), fetched).files


# -- enrichment ---------------------------------------------------------------

def _npm(spark: SparkSession, folder: str) -> DataFrame:
    return E.npm_packages(corpus(spark, folder, "web_scripts"))


_NPM = O.occurrences(O.corpus("web_scripts"), R.category_rules(R.NPM_PACKAGES))


@query("j1_dependency_confusion", f"""
    SELECT page_id, 'Dependency Confusion' AS category, display_key, source, "index" FROM ({_NPM})
    WHERE display_key IN (SELECT package FROM ({O.corpus('registry')}) WHERE status = 404)""")
def _(spark, folder):
    return J.dependency_confusion(_npm(spark, folder), corpus(spark, folder, "registry")).select(
        "page_id", "category", "display_key", "source", "index")


def _maps(spark: SparkSession, folder: str) -> DataFrame:
    return E.source_maps(corpus(spark, folder, "map_scripts")).drop("map_url")


_MAPS = O.occurrences(O.corpus("map_scripts"), R.category_rules(R.SOURCE_MAPS))
# Every script of the corpus qualifies; only an absolute known map suppresses a guess.
_GUESSES = f"""SELECT page_id, source || '.map' AS map_url FROM ({O.corpus('map_scripts')}) s
    WHERE NOT EXISTS (SELECT 1 FROM ({_MAPS}) m WHERE m.page_id = s.page_id AND m.display_key = s.source || '.map')"""
_VALID = f"""SELECT g.page_id, map_url FROM ({_GUESSES}) g JOIN ({O.responses('fetched_maps', 'HEAD')}) f ON f.url = map_url
    WHERE status = 200 AND NOT contains(lower(coalesce(content_type, '')), 'text/html')
        AND (coalesce(content_length, 0) = 0 OR content_length BETWEEN 50 AND 52428800)"""


def _valid_maps(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    guesses = J.guess_maps(corpus(spark, folder, "map_scripts"), found)
    return J.validate_maps(guesses, corpus(spark, folder, "fetched_maps"))


@query("j2_guess_maps", _GUESSES)
def _(spark, folder):
    return J.guess_maps(corpus(spark, folder, "map_scripts"), _maps(spark, folder))


@query("j3_validate_maps", _VALID)
def _(spark, folder):
    return _valid_maps(spark, folder, _maps(spark, folder))


_MERGED = ("page_id", "category", "display_key", "source", "rule_id", "index", "secret_length", "line", "column")


@query("j4_merge_maps", f"""
    SELECT page_id, category, display_key, source, rule_id, "index", secret_length, line, "column" FROM ({_MAPS})
    UNION ALL SELECT page_id, 'Source Maps', map_url, 'Heuristic (Guessed)', 'guessed-source-map', 0, 0, 0, 0 FROM ({_VALID})""")
def _(spark, folder):
    found = materialize(_maps(spark, folder), "maps")
    return J.merge_maps(found, _valid_maps(spark, folder, found)).select(*_MERGED)


_MANIFESTS = f"""SELECT page_id, build_id, prefix || '/_next/static/' || build_id || '/_buildManifest.js' AS manifest_url
    FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'b' || page_id ELSE 'b' || (page_id % 10) END AS build_id,
            CASE WHEN page_id % 6 = 1 THEN 'https://cdn.example.com' ELSE {O.origin('url')} END AS prefix
          FROM pages WHERE page_id % 6 IN (0, 1, 5))"""


@query("j5_next_manifests", _MANIFESTS)
def _(spark, folder):
    return J.next_manifests(corpus(spark, folder, "next_pages"))


_ROUTES = f"""SELECT DISTINCT manifest_url, route_ord, route FROM (
    SELECT manifest_url, unnest(routes) AS route, unnest(range(len(routes))) AS route_ord
    FROM (SELECT url AS manifest_url, regexp_extract_all(body, '"(/[^"]*)"[ ]*:', 1) AS routes
          FROM ({O.responses('fetched_manifests')}) WHERE status = 200)
    WHERE manifest_url IN (SELECT manifest_url FROM ({_MANIFESTS})))
    WHERE NOT starts_with(route, '/_') AND NOT contains(route, '[...')"""


@query("j6_next_routes", _ROUTES)
def _(spark, folder):
    return J.next_routes(J.next_manifests(corpus(spark, folder, "next_pages")), corpus(spark, folder, "fetched_manifests"))


_PAGE_ENDPOINTS = O.occurrences(_PAGE_SOURCES, _BARE)


@query("j7_merge_routes", f"""
    SELECT page_id, category, display_key, source, "index", line, "column" FROM ({_PAGE_ENDPOINTS})
    UNION ALL SELECT DISTINCT page_id, 'Endpoints', route, manifest_url, 0, 1, 1
    FROM ({_MANIFESTS}) m JOIN ({_ROUTES}) r USING (manifest_url)
    WHERE NOT EXISTS (SELECT 1 FROM ({_PAGE_ENDPOINTS}) e WHERE e.page_id = m.page_id AND e.display_key = r.route)""")
def _(spark, folder):
    found = materialize(E.occurrences(_page_sources(spark, folder), _BARE), "endpoints")
    manifests = J.next_manifests(corpus(spark, folder, "next_pages"))
    routes = J.next_routes(manifests, corpus(spark, folder, "fetched_manifests"))
    return J.merge_routes(found, manifests, routes).select(
        "page_id", "category", "display_key", "source", "index", "line", "column")


def _map_urls(spark: SparkSession, folder: str) -> DataFrame:
    maps = corpus(spark, folder, "map_scripts").select(F.concat("source", F.lit(".map")).alias("map_url"))
    lost = maps.select(F.concat("map_url", F.lit(".lost")).alias("map_url"))
    return maps.unionByName(lost)


# 2 + 3 rows per good map: its last src/a, the shared library and the missing file.
_FILES = f"""
    SELECT map_url, source_path, content, origin FROM (
        SELECT url AS map_url, 'src/a' || k || '.js' AS source_path, 'code ' || k AS content, 'embedded' AS origin, status, k
        FROM (SELECT *, CAST(regexp_extract(url, '/js/([0-9]+)[.]', 1) AS BIGINT) AS k
              FROM ({O.responses('fetched_maps')}) WHERE contains(url, '.js.map'))
        UNION ALL SELECT url, '../lib/b.js', 'shared', 'fetched', status, k FROM (
            SELECT *, CAST(regexp_extract(url, '/js/([0-9]+)[.]', 1) AS BIGINT) AS k FROM ({O.responses('fetched_maps')}) WHERE contains(url, '.js.map'))
        UNION ALL SELECT url, 'src/ui/d.js', 'Skipping missing source file: https://cdn.example.com/js/src/ui/d.js (Status: 404)',
            'missing', status, k FROM (
            SELECT *, CAST(regexp_extract(url, '/js/([0-9]+)[.]', 1) AS BIGINT) AS k FROM ({O.responses('fetched_maps')}) WHERE contains(url, '.js.map')))
    WHERE status = 200 AND k % 13 > 1"""
_FAILED = f"""
    SELECT url AS map_url, 'rebuild.error.log' AS source_path, CASE WHEN status = 404 THEN 'Error: HTTP status 404'
        ELSE 'Error: the source map is invalid or lists no sources' END AS content, 'error' AS origin
    FROM ({O.responses('fetched_maps')})
    WHERE contains(url, '.js.map') AND (status = 404 OR CAST(regexp_extract(url, '/js/([0-9]+)[.]', 1) AS BIGINT) % 13 <= 1)
    UNION ALL SELECT source || '.map.lost', 'rebuild.error.log', 'Error: the source map was not fetched', 'error'
    FROM ({O.corpus('map_scripts')})"""


def _rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(J.rebuild_sources(_map_urls(spark, folder), corpus(spark, folder, "fetched_maps")), "rebuilt")


@query("j8_rebuild_sources", f"{_FILES} UNION ALL {_FAILED}")
def _(spark, folder):
    return _rebuilt(spark, folder)


@query("j9_source_tree", f"""
    WITH nodes AS (
        SELECT map_url, array_to_string(p[1:n], '/') AS path, array_to_string(p[1:n - 1], '/') AS parent, p[n] AS name,
            n AS depth, bool_or(n < len(p)) AS is_folder
        FROM (SELECT map_url, string_split(source_path, '/') AS p, unnest(range(1, len(string_split(source_path, '/')) + 1)) AS n
              FROM ({_FILES})) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY map_url, parent, depth ORDER BY is_folder DESC, name) AS position FROM nodes""")
def _(spark, folder):
    files = _rebuilt(spark, folder)
    return J.source_tree(files.where(F.col("source_path") != J.ERROR_PATH))


# -- aggregations -------------------------------------------------------------

_WEB_RULES = R.full_rules()
_WEB = O.occurrences(O.corpus("web_scripts"), _WEB_RULES)


def _web(spark: SparkSession, folder: str) -> DataFrame:
    return E.occurrences(corpus(spark, folder, "web_scripts"), _WEB_RULES)


def _endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return E.occurrences(_page_sources(spark, folder), _BARE)


@query("a1_group_findings", f"""
    SELECT page_id, category, display_key, 0 AS part, len(l) AS n, l[1] AS first_index, l[-1] AS last_index, list_sum(l)::BIGINT AS index_sum
    FROM (SELECT page_id, category, display_key, list("index" ORDER BY source_ord, rule_ord, match_ord) AS l
          FROM ({_PAGE_ENDPOINTS}) GROUP BY ALL)""")
def _(spark, folder):
    grouped = A.group_findings(_endpoints(spark, folder))
    at = F.transform("occurrences", lambda o: o["index"])
    return grouped.select(
        "page_id", "category", "display_key", "part", F.size(at).alias("n"), F.element_at(at, 1).alias("first_index"),
        F.element_at(at, -1).alias("last_index"),
        F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("index_sum"))


@query("a2_unique_occurrences", f"""
    SELECT page_id, category, display_key, source, "index", line, "column" FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, category, display_key, source, "index"
            ORDER BY source_ord DESC, rule_ord DESC, match_ord DESC) AS k
        FROM ({_PAGE_ENDPOINTS} UNION ALL SELECT * REPLACE (9 AS line, 1 AS source_ord) FROM ({_PAGE_ENDPOINTS}) WHERE "index" % 2 = 0))
    WHERE k = 1""")
def _(spark, folder):
    found = materialize(_endpoints(spark, folder), "endpoints")
    again = found.where(F.col("index") % 2 == 0).withColumn("line", F.lit(9)).withColumn("source_ord", F.lit(1))
    return A.unique_occurrences(found.unionByName(again)).select(
        "page_id", "category", "display_key", "source", "index", "line", "column")


@query("a3_section_counts", f"SELECT page_id, category, count(DISTINCT display_key) AS n_keys FROM ({_WEB}) GROUP BY ALL")
def _(spark, folder):
    return A.section_counts(_web(spark, folder))


_TOKENS = O.occurrences(O.corpus("token_scripts"), _FULL_SECRETS)


@query("a4_secrets_by_rule", f"""
    SELECT page_id, rule_id, count(*) AS n_secrets FROM (
        SELECT page_id, display_key, first(rule_id ORDER BY source_ord, rule_ord, match_ord) AS rule_id
        FROM ({_TOKENS}) GROUP BY ALL) GROUP BY ALL""")
def _(spark, folder):
    return A.secrets_by_rule(E.full_secrets(corpus(spark, folder, "token_scripts")))


@query("a5_page_totals", f"""
    SELECT page_id, sum(n)::BIGINT AS total FROM (
        SELECT page_id, count(DISTINCT category || chr(0) || display_key) AS n FROM ({_WEB})
        WHERE category <> 'Potential NPM Packages' GROUP BY page_id
        UNION ALL SELECT page_id, count(DISTINCT source) FROM ({O.corpus('web_scripts')})
        WHERE source <> 'Main HTML Document' GROUP BY page_id) GROUP BY page_id""")
def _(spark, folder):
    return A.page_totals(_web(spark, folder), corpus(spark, folder, "web_scripts"))


_STATUS_RULE = [R.Rule("long-word", R.SECRETS, r"[A-Za-z]{14,}", "g", 0, 3.2, description="long word")]


@query("a6_page_status", f"""
    SELECT p.page_id, p.url, coalesce(n, 0) AS n_findings, CASE WHEN coalesce(n, 0) > 0 THEN 'found' ELSE 'clean' END AS status
    FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n
        FROM ({O.secret_findings(_PAGE_SOURCES, _STATUS_RULE)}) GROUP BY page_id) f USING (page_id)""")
def _(spark, folder):
    return A.page_status(E.secret_findings(_page_sources(spark, folder), _STATUS_RULE), P.read_pages(spark, folder))


@query("a7_section_items", f"SELECT DISTINCT page_id, category, display_key AS item FROM ({_WEB})")
def _(spark, folder):
    return A.section_items(_web(spark, folder))


@query("a8_retain_passive", f"""
    WITH s AS ({_FULL_SOURCES}), f AS ({O.matches('SELECT * FROM s', [R.Rule('load', 'Text', 'load[(]', 'g', 0)])})
    SELECT page_id, source, length(content) AS n_chars FROM s
    WHERE (kind <> 'external' AND page_id IN (SELECT page_id FROM f))
        OR (kind = 'external' AND (page_id, source) IN (SELECT (page_id, source) FROM f))""")
def _(spark, folder):
    sources = _full_sources(spark, folder)
    found = M.match_rule(sources, R.Rule("load", "Text", "load[(]", "g", 0))
    return A.retain_sources(sources, found).select("page_id", "source", F.length("content").alias("n_chars"))


@query("a8_retain_full", f"""
    WITH s AS ({_FULL_SOURCES}), f AS ({O.matches('SELECT * FROM s', [R.Rule('chunk', 'Text', 'chunk/[02]', 'g', 0)])})
    SELECT page_id, source, CASE WHEN kind <> 'external' OR (page_id, source) IN (SELECT (page_id, source) FROM f)
        THEN length(content) END AS n_chars FROM s""")
def _(spark, folder):
    sources = _full_sources(spark, folder)
    found = M.match_rule(sources, R.Rule("chunk", "Text", "chunk/[02]", "g", 0))
    return A.retain_sources(sources, found, P.FULL).select("page_id", "source", F.length("content").alias("n_chars"))


@query("a9_rollup", f"""
    SELECT category, host, rule_id, level::INT AS level, n_occurrences, n_pages FROM (
        SELECT category, host, rule_id, grouping_id(category, host, rule_id) AS level, count(*) AS n_occurrences,
            count(DISTINCT page_id) AS n_pages
        FROM (SELECT *, {O.host('url')} AS host FROM ({_PAGE_ENDPOINTS})) GROUP BY ROLLUP (category, host, rule_id))""")
def _(spark, folder):
    return A.rollup_findings(_endpoints(spark, folder))


# -- store and streams --------------------------------------------------------

_EVENTS = "SELECT event_id, ts, user_id AS tab_id FROM events"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("tab_id"))


_GAP_MS = 3_600_000


@query("t2_debounce", f"""
    SELECT event_id, tab_id FROM (
        SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS follower FROM ({_EVENTS}))
    WHERE follower IS NULL OR follower - epoch_us(ts) >= {_GAP_MS * 1000}""")
def _(spark, folder):
    return S.debounce(_events(spark, folder), gap_ms=_GAP_MS).select("event_id", "tab_id")


def _stream_of(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    path = f"{shared_dir(spark, name)}/in"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all it has and read what it wrote."""
    root = shared_dir(stream.sparkSession, name)
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query("t1_scan_stream", f"""
    SELECT page_id, id, source, line, "column", secret FROM ({O.secret_findings(O.corpus('token_scripts'), R.strict_rules())})""")
def _(spark, folder):
    texts = corpus(spark, folder, "token_scripts")
    return _drain(E.secret_findings(_stream_of(spark, texts, "texts")), "scan").select(
        "page_id", "id", "source", "line", "column", "secret")


@query("t1_t4_scan_into_store", f"""
    SELECT 'passive_scan|' || url AS key, url, 'complete' AS status, 0 AS n_findings FROM pages WHERE {_SCANNABLE}""")
def _(spark, folder):
    root = shared_dir(spark, "store")
    run = jobs.run_scan(
        jobs.stream_pages(spark, folder, "pages.parquet"), f"{root}/findings", f"{root}/results", f"{root}/checkpoint")
    run.awaitTermination()
    return jobs.current_results(spark, f"{root}/results").select("key", "url", "status", "n_findings")


@query("t1_t4_job_into_store", f"""
    {_JOB_LISTED}, found AS MATERIALIZED (SELECT page_id FROM ({_JOB_FOUND}))
    SELECT 'passive_scan|' || url AS key, url, 'complete' AS status, (SELECT count(*) FROM found f WHERE f.page_id = p.page_id) AS n_findings
    FROM ({_JOB_WANTED}) p""")
def _(spark, folder):
    root = shared_dir(spark, "store")
    pages = _stream_of(spark, corpus(spark, folder, "job_pages"), "pages")
    run = jobs.run_scan(
        pages, f"{root}/findings", f"{root}/results", f"{root}/checkpoint", fetched=corpus(spark, folder, "job_fetched"), max_bytes=None)
    run.awaitTermination()
    return jobs.current_results(spark, f"{root}/results").select("key", "url", "status", "n_findings")


@query("t2_debounce_stream", f"""
    SELECT event_id, tab_id FROM (
        SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS follower FROM ({_EVENTS}))
    WHERE follower IS NULL OR follower - epoch_us(ts) >= {_GAP_MS * 1000}""")
def _(spark, folder):
    events = _events(spark, folder)
    ended = events.unionByName(jobs.closing_event(events, _GAP_MS))
    return _drain(jobs.debounce_stream(_stream_of(spark, ended, "events"), gap_ms=_GAP_MS), "debounce").select("event_id", "tab_id")


@query("t3_skip_scanned", f"""
    SELECT DISTINCT tab_id, url FROM ({O.corpus('nav_events')}) WHERE {_SCANNABLE}
        AND url NOT IN (SELECT url FROM ({O.corpus('nav_events')}) WHERE event_id % 7 = 0)""")
def _(spark, folder):
    events = corpus(spark, folder, "nav_events")
    store = events.where(F.col("event_id") % 7 == 0).select("url", F.lit("complete").alias("status"))
    return S.skip_scanned(events, store).select("tab_id", "url")


@query("t3_first_scans_stream", f"SELECT DISTINCT tab_id, url FROM ({O.corpus('nav_events')})")
def _(spark, folder):
    # One batch, and a lateness that spans it: every pair comes out once.
    events = corpus(spark, folder, "nav_events")
    stream = jobs.first_scans(_stream_of(spark, events, "visits"), lateness="3650 days")
    return _drain(stream, "first").select("tab_id", "url")


_STORE = O.corpus("results_store")


@query("t4_upsert_results", f"""
    SELECT key, url, status, n_findings, timestamp_ms FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(timestamp_ms, -1) DESC,
            CASE WHEN status = 'scanning' THEN 0 ELSE 1 END DESC, n_findings DESC NULLS LAST, status DESC NULLS LAST) AS place
        FROM ({_STORE}))
    WHERE place = 1 AND status <> 'failed'""")
def _(spark, folder):
    rows = corpus(spark, folder, "results_store")
    half = F.col("n_findings") % 2 == 0
    return S.upsert_results(rows.where(half), rows.where(~half)).select("key", "url", "status", "n_findings", "timestamp_ms")


@query("t4_kept_store", ORACLE["t4_upsert_results"])
def _(spark, folder):
    # In five batches, the third of which comes twice.
    rows = corpus(spark, folder, "results_store")
    store = KeptStore(spark, f"{shared_dir(spark, 'kept')}/store", rows.schema, buckets=16)
    for i in (0, 1, 2, 2, 3, 4):
        store.upsert(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(5)) == i), "run", i)
    return store.current().select("key", "url", "status", "n_findings", "timestamp_ms")


_AGE = 10_000_000


@query("t5_kept_expiry", f"""
    SELECT key, timestamp_ms FROM ({ORACLE["t4_upsert_results"]})
    WHERE NOT (starts_with(key, 'passive_scan') AND coalesce({_NOW} - timestamp_ms > {_AGE}, FALSE))""")
def _(spark, folder):
    rows = corpus(spark, folder, "results_store")
    store = KeptStore(spark, f"{shared_dir(spark, 'kept')}/store", rows.schema, buckets=16)
    store.upsert(rows)
    store.expire(_NOW, _AGE)
    return store.current().select("key", "timestamp_ms")


@query("t1_t3_job_into_kept_store", ORACLE["t1_t4_job_into_store"])
def _(spark, folder):
    # A second stream over the same pages finds all results there and adds none.
    root = shared_dir(spark, "kept")
    pages, fetched = corpus(spark, folder, "job_pages"), corpus(spark, folder, "job_fetched")
    for turn in ("first", "second"):
        jobs.run_kept_scan(
            _stream_of(spark, pages, "pages"), f"{root}/findings", f"{root}/store", f"{root}/{turn}", fetched=fetched,
            max_bytes=None).awaitTermination()
    return KeptStore(spark, f"{root}/store").current().select("key", "url", "status", "n_findings")


@query("t5_expire_results", f"""
    SELECT key, timestamp_ms FROM ({_STORE})
    WHERE NOT (starts_with(key, 'passive_scan') AND coalesce({_NOW} - timestamp_ms > {_AGE}, FALSE))""")
def _(spark, folder):
    return S.expire_results(corpus(spark, folder, "results_store"), _NOW, _AGE).select("key", "timestamp_ms")


@query("t5_purge", f"SELECT key, timestamp_ms FROM ({_STORE}) WHERE NOT starts_with(key, 'passive_scan')")
def _(spark, folder):
    return S.expire_results(corpus(spark, folder, "results_store"), _NOW, S.PURGE_ALL).select("key", "timestamp_ms")


@query("t5_read_results", f"SELECT key, timestamp_ms FROM ({_STORE}) WHERE {_NOW} - timestamp_ms <= {_AGE}")
def _(spark, folder):
    return S.read_results(corpus(spark, folder, "results_store"), _NOW, _AGE).select("key", "timestamp_ms")


@query("t6_migrate_store", f"""
    SELECT key, status, coalesce(timestamp_ms, {_NOW}) AS timestamp_ms FROM ({_STORE}) WHERE starts_with(key, 'passive_scan')""")
def _(spark, folder):
    return S.migrate_store(corpus(spark, folder, "results_store"), _NOW).select("key", "status", "timestamp_ms")


@query("t7_recent_pages", f"""
    SELECT url, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used FROM ({O.corpus('nav_events')}) GROUP BY url ORDER BY max(ts) DESC, url LIMIT 100""")
def _(spark, folder):
    return S.recent_pages(corpus(spark, folder, "nav_events")).select(
        "url", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_used"))


_SCANS = """SELECT event_id, user_id AS tab_id, ts AS started_at, ts + INTERVAL 2 HOUR AS finished_at FROM events WHERE event_type <> 'error'"""


def _scans_and_closings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = _table(spark, folder, "events").withColumnRenamed("user_id", "tab_id")
    scans = events.where(F.col("event_type") != "error").select(
        "event_id", "tab_id", F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("finished_at"))
    return scans, events.where(F.col("event_type") == "error").select("tab_id", F.col("ts").alias("closed_at"))


@query("t8_drop_cancelled", f"""
    SELECT event_id FROM ({_SCANS}) s LEFT JOIN (
        SELECT user_id AS tab_id, max(ts) AS closed_at FROM events WHERE event_type = 'error' GROUP BY user_id) c USING (tab_id)
    WHERE NOT coalesce(closed_at BETWEEN started_at AND finished_at, FALSE)""")
def _(spark, folder):
    return S.drop_cancelled(*_scans_and_closings(spark, folder)).select("event_id")


_LONG_SCANS = _SCANS.replace("INTERVAL 2 HOUR", "INTERVAL (event_id % 7 * 20) MINUTE")


# Scans of up to two hours against every closing of their tab, as streams.
@query("t8_drop_cancelled_stream", f"""
    SELECT event_id FROM ({_LONG_SCANS}) s WHERE NOT EXISTS (SELECT 1 FROM events c
        WHERE c.event_type = 'error' AND c.user_id = s.tab_id AND c.ts BETWEEN started_at AND finished_at)""")
def _(spark, folder):
    scans, closed = _scans_and_closings(spark, folder)
    scans = scans.withColumns({"started_at": F.col("started_at").cast("timestamp"), "finished_at": (
        F.col("started_at") + F.make_interval(mins=F.col("event_id").cast("int") % 7 * 20)).cast("timestamp")})
    scans, closed = jobs.with_ends(scans, closed.withColumn("closed_at", F.col("closed_at").cast("timestamp")))
    kept = jobs.drop_cancelled_stream(_stream_of(spark, scans, "scans"), _stream_of(spark, closed, "closed"), longest="2 hours")
    return _drain(kept, "uncancelled").select("event_id")


@query("t9_evict_tab", f"""
    SELECT DISTINCT tab_id || '|' || url AS key FROM ({O.corpus('nav_events')})
    WHERE tab_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)""")
def _(spark, folder):
    keys = corpus(spark, folder, "nav_events").select(S.session_key(F.col("tab_id"), F.col("url")).alias("key")).distinct()
    closed = _table(spark, folder, "events").where(F.col("event_id") % 97 == 0).select(F.col("user_id").alias("tab_id"))
    return S.evict_tab(keys, closed)


_BUDGET = 4000


@query("t10_budget", f"""
    SELECT page_id, source, CASE WHEN n <= {_BUDGET} THEN length(content) END AS n_chars,
        CASE WHEN n > {_BUDGET} THEN 'QUOTA_EXCEEDED' END AS error
    FROM ({_PAGE_SOURCES}) JOIN (SELECT page_id, sum(n) AS n FROM (
        SELECT page_id, octet_length(encode(to_json(map([source], [content]))::VARCHAR)) - 1 AS n FROM ({_PAGE_SOURCES})
        UNION ALL SELECT page_id, octet_length(encode(to_json({{'display_key': display_key, 'source': source, 'index': "index"}})::VARCHAR)) + 1
        FROM ({_PAGE_ENDPOINTS})) GROUP BY page_id) USING (page_id)""")
def _(spark, folder):
    sources = _page_sources(spark, folder)
    found = E.occurrences(sources, _BARE).select("page_id", "display_key", "source", "index")
    return S.apply_budget(sources, found, _BUDGET).select(
        "page_id", "source", F.length("content").alias("n_chars"), "error")


# -- sinks --------------------------------------------------------------------

@query("k1_reports", f"""
    SELECT page_id, 'recon_' || {O.host('url')} AS report_host, 0 AS part, count(*) AS n_occurrences, count(DISTINCT display_key) AS n_keys,
        any_value(length(html)) AS n_text
    FROM pages LEFT JOIN ({_PAGE_ENDPOINTS}) e USING (page_id, url) GROUP BY page_id, url""")
def _(spark, folder):
    root = shared_dir(spark, "reports")
    found = materialize(_endpoints(spark, folder), "endpoints")
    K.write_reports(K.page_reports(P.read_pages(spark, folder), found, _page_sources(spark, folder)), root)
    stored = spark.read.schema("page_id bigint, report_name string, part int, report string").json(root)
    parsed = F.from_json(
        "report", "struct<findings:map<string,map<string,array<struct<index:int>>>>,sources:map<string,string>>")
    keys = F.try_element_at(F.col("r.findings"), F.lit(R.ENDPOINTS))
    return stored.withColumn("r", parsed).select(
        "page_id", F.regexp_extract("report_name", r"^(recon_[^_]+?)(?:_.*)?\.json\z", 1).alias("report_host"), "part",
        F.aggregate(F.map_values(keys), F.lit(0).cast("bigint"), lambda n, o: n + F.size(o)).alias("n_occurrences"),
        F.size(keys).cast("bigint").alias("n_keys"),
        F.length(F.try_element_at(F.col("r.sources"), F.lit("HTML Document"))).alias("n_text"))


@query("k2_report_name", f"""
    SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'recon_scan_results.json' WHEN path = '' THEN 'recon_' || h || '.json'
        ELSE 'recon_' || h || '_' || replace(path, '/', '_') || '.json' END AS report_name
    FROM (SELECT page_id, {O.host('url')} AS h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '^/', ''), '/$', '') AS path FROM pages)""")
def _(spark, folder):
    url = F.when(F.col("page_id") % 10 == 9, "not-a-valid-url").otherwise(F.col("url"))
    return P.read_pages(spark, folder).select("page_id", U.report_name(url).alias("report_name"))


@query("k3_source_dumps", f"""
    SELECT map_url, 0 AS part, count(*) AS file_count, regexp_extract(map_url, '[^/]*$') || '-dump.json' AS dump_name,
        max(content) FILTER (WHERE origin = 'embedded') AS code, '2024-01-01T00:00:00.000Z' AS extracted_at
    FROM ({_FILES}) GROUP BY map_url""")
def _(spark, folder):
    root = shared_dir(spark, "dumps")
    K.write_source_dump(K.source_dumps(_rebuilt(spark, folder), F.lit("2024-01-01").cast("timestamp")), root)
    stored = spark.read.schema("map_url string, part int, file_count bigint, dump_name string, dump string").json(root)
    parsed = F.from_json("dump", "struct<metadata:struct<extractedAt:string,fileCount:bigint>,sources:map<string,string>>")
    path = F.concat(F.lit("src/a"), F.regexp_extract("map_url", r"/js/([0-9]+)\.", 1), F.lit(".js"))
    return stored.withColumn("d", parsed).select(
        "map_url", "part", F.col("d.metadata.fileCount").alias("file_count"), "dump_name",
        F.try_element_at(F.col("d.sources"), path).alias("code"), F.col("d.metadata.extractedAt").alias("extracted_at"))


@query("k4_findings_table", f"""
    SELECT page_id, id, source, line, "column", sha256(secret) AS secret_sha256, length(secret) AS secret_length,
        CASE WHEN length(secret) > 12 THEN left(secret, 4) || '...' END AS secret_hint, 'Potential Secrets' AS category
    FROM ({O.secret_findings(O.corpus('token_scripts'), R.strict_rules())})""")
def _(spark, folder):
    root = shared_dir(spark, "findings")
    K.write_findings(E.secret_findings(corpus(spark, folder, "token_scripts")), root)
    return spark.read.parquet(root).select(
        "page_id", "id", "source", "line", "column", "secret_sha256", "secret_length", "secret_hint", "category")
