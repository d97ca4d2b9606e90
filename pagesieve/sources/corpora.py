"""Script corpora derived from the warehouse tables.

The sample tables hold few of the things the scan looks for, so texts that
hold them are derived from table keys and grow with the tables.  Each query is
written in the SQL that Spark and other engines share; ``<name>`` stands for a
table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_Q = "chr(39)"   # a single quote, spelled alike everywhere
_NL = "chr(10)"
_BS = "chr(92)"

_HEX = "0123456789abcdef"
# Two disjoint alphabets lift a hex digest over four bits per character.
_WIDE = f"""translate(md5(%s || 'x'), '{_HEX}', 'GHJKMNPQRSTVWXYZ') || translate(md5(%s || 'y'), '{_HEX}', 'abcdefghkmnpqrst')"""


def _key(column: str) -> str:
    return f"CAST({column} AS STRING)"


CORPORA = {
    # Pages with external scripts, an empty src, a decoy and a comment added.
    "site_pages": """
        SELECT page_id, url, html || '<script src="/static/app' || (page_id % 7) || '.js"></script>'
            || '<script async src="../lib/./v' || (page_id % 3) || '/x.js?b=' || (page_id % 5) || '&amp;c=1"></script>'
            || '<script src="">f(' || page_id || ')</script>'
            || '<SCRIPT data-src="/no.js" title="a>b">g()</SCRIPT >'
            || '<!-- <script src="/gone.js"></script> --><noscript><script>h()</script></noscript>' AS html
        FROM <pages>""",
    # What a crawler recorded for the first of those scripts: each twice, and a probe.
    "fetched_scripts": """
        WITH own AS (SELECT DISTINCT regexp_replace(url, '^(https?://[^/?#]*).*$', '%s1') || '/static/app' || (page_id % 7) || '.js' AS url,
            'GET' AS method, CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status,
            'text/javascript' AS content_type, CAST(NULL AS BIGINT) AS content_length,
            CASE WHEN page_id % 7 = 5 THEN '' ELSE 'load("/chunk/' || (page_id % 7) || '.js");' END AS body
        FROM <pages>)
        SELECT * FROM own UNION ALL SELECT * FROM own
        UNION ALL SELECT url, 'HEAD', status, content_type, content_length, '' FROM own""",
    "api_scripts": f"""
        SELECT o_orderkey AS page_id, 'https://shop.example.com/' AS url,
            'https://cdn.example.com/o' || o_orderkey || '.js' AS source, 1 AS source_ord,
            CASE o_orderkey % 5
            WHEN 0 THEN 'fetch("/api/orders/' || o_orderkey || '", {{headers: [], method: ' || {_Q} || 'post' || {_Q} || '}});'
            WHEN 1 THEN 'axios.get("/v1/orders/' || o_orderkey || '/items");' || {_NL} || '  axios . PUT ( "/v1/put/' || o_orderkey || '" )'
            WHEN 2 THEN 'apiClient.delete("/svc/' || o_orderkey || '");' || {_NL} || 'myhttp.get("/no/' || o_orderkey || '")'
            WHEN 3 THEN 'x.open("get", "https://api.example.com/q/' || o_orderkey || '", true);'
            ELSE {_NL} || 'var a = "/path/' || o_orderkey || '?x=1", b = ' || {_Q} || '/only' || {_Q} || ', c = "/", d = "//cdn";'
            END AS content
        FROM <orders>""",
    "map_scripts": f"""
        SELECT p_partkey AS page_id, 'https://app.example.com/' AS url,
            'https://cdn.example.com/js/' || p_partkey || '.js' AS source, 1 AS source_ord,
            'var a=1;' || {_NL} || CASE p_partkey % 4
            WHEN 0 THEN '//# sourceMappingURL=' || p_partkey || '.js.map'
            WHEN 1 THEN '/*# sourceMappingURL=/maps/' || p_partkey || '.map */'
            WHEN 2 THEN '//# sourceMappingURL=https://cdn.example.com/js/' || p_partkey || '.js.map'
            ELSE '/*! lib-' || p_partkey || ' v' || (p_partkey % 9) || '.2.0 */' END AS content
        FROM <part>""",
    "fetched_maps": """
        WITH own AS (SELECT 'https://cdn.example.com/js/' || p_partkey || '.js.map' AS url, 'GET' AS method,
            CASE WHEN p_partkey % 11 = 3 THEN 404 ELSE 200 END AS status,
            CASE WHEN p_partkey % 5 = 0 THEN 'Text/HTML; charset=utf-8' WHEN p_partkey % 5 = 1 THEN NULL
                ELSE 'application/json' END AS content_type,
            CAST(CASE p_partkey % 7 WHEN 0 THEN 20 WHEN 1 THEN 60000000 WHEN 2 THEN NULL WHEN 3 THEN 0
                ELSE 1000 + p_partkey END AS BIGINT) AS content_length,
            CASE WHEN p_partkey % 13 = 0 THEN '{"sources": [' WHEN p_partkey % 13 = 1 THEN '{"version": 3}' ELSE
            '{"version":3,"sources":["src/a' || p_partkey || '.js","../lib/b.js","webpack:///c.js","src/ui/d.js","src/a' || p_partkey
                || '.js"],"sourcesContent":["old","","","",' || '"code ' || p_partkey || '"]}' END AS body
        FROM <part>
        UNION ALL SELECT 'https://cdn.example.com/lib/b.js', 'GET', 200, 'text/javascript', CAST(NULL AS BIGINT), 'shared'
        FROM <region> WHERE r_regionkey = 0
        UNION ALL SELECT 'https://cdn.example.com/js/src/ui/d.js', 'GET', 404, 'text/html', CAST(NULL AS BIGINT), 'gone'
        FROM <region> WHERE r_regionkey = 0)
        SELECT * FROM own UNION ALL SELECT * FROM own
        UNION ALL SELECT url, 'HEAD', status, content_type, content_length, '' FROM own""",
    "web_scripts": f"""
        SELECT c_custkey AS page_id, 'https://www.shop.co.uk/' AS url, 'Inline Script #1' AS source, 1 AS source_ord,
            CASE c_custkey % 6
            WHEN 0 THEN 'el.innerHTML = x' || c_custkey || '; el.src=1;' || {_NL} || ' eval(y); a.append (z)'
            WHEN 1 THEN 'post("https://api.shop.co.uk/v2/graphql?op=' || c_custkey || '"); q=' || {_Q} || '/api/graphql' || {_Q}
            WHEN 2 THEN 'const q = gql`query Q' || c_custkey || ' {{ id }}`; mutation M' || c_custkey || '($a: Int) __schema {{ x }}'
            WHEN 3 THEN 'import a from "@corp' || c_custkey || '/ui-kit"; const b = require("@corp' || (c_custkey % 7) || '/lib");'
            WHEN 4 THEN '{{"name": "@corp' || (c_custkey % 25) || '/lib' || c_custkey || '", "token": "t", "?redirect_to=": 1}}'
            ELSE 'go("https://cdn' || c_custkey || '.shop.co.uk/x?url=1&returnTo=2"); u="http://www.shop.co.uk"; v="evil.org/a.shop.co.ukx"' END AS content
        FROM <customer>""",
    # Shaped like credentials, made up from digests of keys.
    "token_scripts": f"""
        SELECT o_orderkey AS page_id, 'https://shop.example.com/' AS url,
            'https://cdn.example.com/t' || o_orderkey || '.js' AS source, 1 AS source_ord,
            CASE o_orderkey % 8
            WHEN 0 THEN 'k = "ghp_' || substr(md5({_key('o_orderkey')}) || md5({_key('o_custkey')}), 1, 36) || '";'
            WHEN 1 THEN 'k = "ghp_' || repeat('ab', 18) || '";'
            WHEN 2 THEN {_NL} || 'aws AKIA' || translate(upper(substr(md5({_key('o_orderkey')}), 1, 16)), '0189', 'WXYZ') || ' end'
            WHEN 3 THEN 'api_key = "' || {_WIDE % (_key('o_orderkey'), _key('o_orderkey'))} || '"'
            WHEN 4 THEN 'auth_token: ' || {_Q} || md5({_key('o_orderkey')}) || {_Q} || ';'
            WHEN 5 THEN 'GLPAT-' || upper(substr(md5({_key('o_orderkey')}), 1, 20)) || ' adobe_id = ' || md5({_key('o_custkey')}) || ';'
            WHEN 6 THEN 'Authorization: Bearer ' || {_WIDE % (_key('o_orderkey'), _key('o_custkey'))} || {_NL} || 'dapi' || md5({_key('o_orderkey')})
            ELSE 'nothing here for order ' || o_orderkey END AS content
        FROM <orders>""",
    "registry": """
        SELECT DISTINCT '@corp' || (c_custkey % 25) || '/lib' || c_custkey AS package,
            CASE WHEN c_custkey % 4 = 0 THEN 404 ELSE 200 END AS status
        FROM <customer> WHERE c_custkey % 5 <> 1""",
    "next_pages": """
        SELECT page_id, url, '<html><script id="__NEXT_DATA__" type="application/json">' || CASE page_id % 6
            WHEN 0 THEN '{"buildId":"b' || page_id || '"}'
            WHEN 1 THEN '{"buildId":"b' || (page_id % 10) || '","assetPrefix":"https://cdn.example.com/"}'
            WHEN 2 THEN '{"buildId": ' || page_id || '}'
            WHEN 3 THEN '{"buildId":"x",}'
            WHEN 4 THEN '{"props":{}}'
            ELSE '{"buildId":"b' || (page_id % 10) || '","assetPrefix":""}' END || '</script></html>' AS html
        FROM <pages>""",
    "fetched_manifests": """
        WITH own AS (SELECT 'https://cdn.example.com/_next/static/b' || n_nationkey || '/_buildManifest.js' AS url, 'GET' AS method,
            CASE WHEN n_nationkey % 4 = 3 THEN 500 ELSE 200 END AS status, 'text/javascript' AS content_type,
            CAST(NULL AS BIGINT) AS content_length,
            'self.__BUILD_MANIFEST={"/":["a.js"],"/n' || n_nationkey || '" : [],"/_app":[],"/p/[...slug]":[],"/x/[[...y]]":[],"sortedPages":["/","/q"]}' AS body
        FROM <nation>)
        SELECT * FROM own UNION ALL SELECT * FROM own
        UNION ALL SELECT url, 'HEAD', status, content_type, content_length, '' FROM own""",
    "nav_events": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS tab_id, CAST(event_id % 3 AS INT) AS frame_id,
            CASE event_id % 4 WHEN 0 THEN 'https://chromewebstore.google.com/x' WHEN 1 THEN 'about:blank'
                ELSE 'https://site' || (user_id % 50) || '.example.com/p' || (event_id % 10) END AS url
        FROM <events>""",
    "results_store": """
        SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_custkey || '|https://s' || o_custkey || '.example.com/'
                ELSE 'passive_scan|https://s' || o_custkey || '.example.com/' END AS key,
            'https://s' || o_custkey || '.example.com/' AS url,
            CASE o_orderkey % 5 WHEN 0 THEN 'scanning' WHEN 1 THEN 'failed' ELSE 'complete' END AS status,
            CAST(o_orderkey % 10 AS BIGINT) AS n_findings,
            CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 1700000000000 + o_orderkey * 60000 END AS timestamp_ms,
            CAST(NULL AS STRING) AS error
        FROM <orders>""",
}

# A site for whole jobs: pages with a secret hidden by some encoding and build data, and what was fetched for them.
CORPORA["job_pages"] = f"""
    SELECT page_id, url, html || '<script>var k = "' || CASE page_id % 4 WHEN 0 THEN {_BS} || 'u0067' WHEN 1 THEN '%67'
            WHEN 2 THEN '&#103;' ELSE 'g' END || 'hp_' || substr(md5({_key('page_id')}) || md5({_key('page_id')} || 'x'), 1, 36) || '";</script>'
        || CASE page_id % 6 WHEN 1 THEN '<script id="__NEXT_DATA__" type="application/json">{{"buildId":"b' || (page_id % 10)
            || '","assetPrefix":"https://cdn.example.com/"}}</script>' ELSE '' END AS html
    FROM ({CORPORA['site_pages']})"""
_SITES = """(SELECT DISTINCT regexp_replace(url, '^(https?://[^/?#]*).*$', '%s1') AS site, page_id % 7 AS k FROM <pages>)"""
CORPORA["job_fetched"] = f"""
    WITH own AS (
        SELECT site || '/static/app' || k || '.js' AS url, 'GET' AS method, CASE k WHEN 3 THEN 404 ELSE 200 END AS status,
            'text/javascript' AS content_type, CAST(NULL AS BIGINT) AS content_length,
            CASE k WHEN 5 THEN '' ELSE 'load("/chunk/' || k || '.js"); t = "%67hp_' || substr(md5({_key('k')}) || md5({_key('k')} || 'z'), 1, 36)
                || '"; import a from "@corp' || k || '/kit";' || {_NL} || '//# sourceMappingURL=app' || k || '.js.map' END AS body
        FROM {_SITES}
        UNION ALL SELECT site || '/static/app' || k || '.js.map', 'GET', 200, 'application/json', CAST(1000 AS BIGINT),
            '{{"version":3,"sources":["src/a.js","src/lost.js"],"sourcesContent":["code ' || k || '",""]}}'
        FROM {_SITES} WHERE k < 3)
    SELECT * FROM own UNION ALL SELECT * FROM own
    UNION ALL SELECT url, 'HEAD', status, content_type, content_length, '' FROM own
    UNION ALL SELECT url, method, status, content_type, content_length, body FROM ({CORPORA['fetched_manifests']})"""
CORPORA["job_registry"] = """
    SELECT DISTINCT '@corp' || (page_id % 7) || '/kit' AS package, CASE WHEN page_id % 7 IN (0, 2, 3) THEN 404 ELSE 200 END AS status FROM <pages>"""


def corpus_sql(name: str, table: str = "{}", group: str = "\\") -> str:
    """SQL of a corpus; ``table`` formats table names, ``group`` begins a group reference."""
    text = CORPORA[name].replace("'%s1'", f"'{group}1'")
    return re.sub(r"<([a-z]+)>(?=[\s)]|$)", lambda m: table.format(m.group(1)), text)


def corpus(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(corpus_sql(name, f"parquet.`{folder.rstrip('/')}/{{}}.parquet`", "$"))
