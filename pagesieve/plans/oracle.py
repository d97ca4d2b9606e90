"""SQL that states what the scan should find, for checks on another engine.

The statements run on RE2, which has neither look-around nor back-references;
the two rules that use them are spelled out as alternatives here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pagesieve import rules as R
from pagesieve.functions.dialect import _RE2, space_class, to_re2
from pagesieve.functions.urls import REGISTRY_LABELS
from pagesieve.sources.corpora import corpus_sql


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def corpus(name: str) -> str:
    return corpus_sql(name)


_PATH = r"(?:/(?:[a-zA-Z0-9_?&=\-#.][a-zA-Z0-9_?&=/\-#.]*)?)"
_GRAPHQL_PATH = r"""(?:(?:https?://[^"'\s]*)?(?:/api)?(?:/v\d+)?/graphql(?:\?[^"']*)?)"""


def _quoted(body: str) -> str:
    return "|".join(q + body + q for q in ('"', "'", "`"))


def _re2(rule: R.Rule) -> tuple[str, str]:
    """Pattern, and SQL for the finding of match ``i``."""
    if rule.rule_id == "endpoint-bare-url":
        return _quoted(_PATH), "substring(m0[i], 2, length(m0[i]) - 2)"
    if r"/graphql)" in rule.pattern:
        return to_re2(_quoted(_GRAPHQL_PATH)), r"regexp_replace(substring(m0[i], 2, length(m0[i]) - 2), '\?.*$', '')"
    return to_re2(rule.pattern, rule.ignore_case), "coalesce(mg[i], '')"


def matches(source: str, rules: Sequence[R.Rule]) -> str:
    """Rows of every match of every rule over the table expression ``source``."""
    branches = []
    for i, rule in enumerate(rules):
        pattern, finding = _re2(rule)
        p = lit(pattern)
        method = f"regexp_extract_all(content, {p}, {rule.method_group})" if rule.method_group else "NULL::VARCHAR[]"
        group = rule.group if "mg" in finding else 0
        branches.append(f"""
        SELECT * EXCLUDE (m0, mg, mm, segs, i, content), {finding} AS finding, upper(mm[i]) AS http_method, m0[i] AS match,
            (list_sum(list_transform(segs[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m0[1:i - 1], lambda x: length(x))), 0))::BIGINT AS "index",
            i - 1 AS match_ord, content
        FROM (SELECT *, unnest(range(1, len(m0) + 1)) AS i FROM (
            SELECT *, {i} AS rule_ord, {lit(rule.rule_id)} AS rule_id, {lit(rule.category)} AS category,
                {lit(rule.description)} AS description, {rule.entropy if rule.entropy else 'NULL'}::DOUBLE AS entropy_floor,
                regexp_extract_all(content, {p}, 0) AS m0, regexp_extract_all(content, {p}, {group}) AS mg,
                {method} AS mm, string_split_regex(content, {p}) AS segs
            FROM ({source}) WHERE regexp_matches(content, {p})))""")
    union = "\nUNION ALL".join(branches)
    return f"""SELECT * EXCLUDE (content, pre), 1 + length(pre) - length(replace(pre, chr(10), '')) AS line,
        length(string_split(pre, chr(10))[-1]) + 1 AS "column"
    FROM (SELECT *, substring(content, 1, "index") AS pre FROM ({union}))"""


def entropy(text: str) -> str:
    return f"coalesce(list_entropy(string_split({text}, '')), 0)"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_ip(name: str) -> str:
    return f"regexp_full_match({name}, '{_OCTET}([.]{_OCTET}){{3}}')"


def base_domain(name: str) -> str:
    parts = f"string_split({name}, '.')"
    labels = ", ".join(lit(x) for x in REGISTRY_LABELS)
    return f"""CASE WHEN {is_ip(name)} THEN NULL WHEN len({parts}) <= 2 THEN {name}
        WHEN {parts}[-2] IN ({labels}) THEN array_to_string({parts}[-3:], '.')
        ELSE array_to_string({parts}[-2:], '.') END"""


def occurrences(source: str, rules: Sequence[R.Rule]) -> str:
    """The long findings table of the full scan."""
    ws = space_class(_RE2)
    h, b = host("url"), base_domain(host("url"))
    return f"""SELECT page_id, url, category,
        CASE WHEN http_method IS NOT NULL THEN '[' || http_method || '] ' || finding ELSE finding END AS display_key,
        source, rule_id, "index", length(finding) AS secret_length, line, "column", http_method,
        source_ord, rule_ord, match_ord
    FROM (SELECT * REPLACE (regexp_replace(finding, '^[{ws}]+|[{ws}]+$', '', 'g') AS finding)
          FROM ({matches(source, rules)}))
    WHERE finding <> '' AND CASE category
        WHEN 'Subdomains' THEN coalesce(NOT {is_ip(h)} AND (finding = {h} OR ends_with(finding, '.' || {h})
            OR finding = {b} OR ends_with(finding, '.' || {b})), FALSE)
        WHEN 'Potential Secrets' THEN entropy_floor IS NULL OR {entropy('finding')} >= entropy_floor
        WHEN 'Endpoints' THEN NOT regexp_full_match(finding, '/+') ELSE TRUE END"""


def secret_findings(source: str, rules: Sequence[R.Rule]) -> str:
    return f"""SELECT page_id, rule_id AS id, description, finding AS secret, source, FALSE AS is_source_too_large,
        line, "column", rule_ord, match_ord
    FROM ({matches(source, rules)}) WHERE entropy_floor IS NULL OR {entropy('finding')} >= entropy_floor"""


_ELEMENTS = "|".join(
    rf"""<{tag}(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>.*?</{tag}[\s/>]"""
    for tag in ("style", "textarea", "title", "noscript"))
_SCRIPT = r"""<script(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>.*?</script[\s/>]"""
_SCRIPT_PARTS = r"""(?is)^<script((?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?)>(.*?)</script[\s/>]"""
_SRC = r"""(?is)(?:^|["'\s/])src\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def script_tags(pages: str) -> str:
    """page_id, url, n, has_src, src, body of the scripts of a page."""
    pattern = lit("(?is)<!--.*?-->|" + _ELEMENTS + "|" + _SCRIPT)
    parts, src = lit(_SCRIPT_PARTS), lit(_SRC)
    return f"""SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, body,
            regexp_matches(attrs, {src}) AS has_src,
            replace(regexp_extract(attrs, {src}, 1) || regexp_extract(attrs, {src}, 2) || regexp_extract(attrs, {src}, 3),
                '&amp;', '&') AS src
        FROM (SELECT page_id, url, i, regexp_extract(el, {parts}, 1) AS attrs, regexp_extract(el, {parts}, 2) AS body
              FROM (SELECT page_id, url, unnest(els) AS el, unnest(range(len(els))) AS i
                    FROM (SELECT page_id, url, regexp_extract_all(html, {pattern}, 0) AS els FROM ({pages})))
              WHERE lower(left(el, 7)) = '<script')"""


def responses(name: str, method: str = "GET") -> str:
    """What was recorded by a method, each record once; no URL of the corpora has two that differ."""
    return f"SELECT DISTINCT * FROM ({corpus(name)}) WHERE method = '{method}'"


def sources(pages: str, mode: str) -> str:
    name = "HTML Document" if mode == "passive" else "Main HTML Document"
    html = "html" if mode == "passive" else (
        "CASE WHEN regexp_matches(html, '(?is)^(?:\\s|<!--.*?-->)*<!doctype') THEN html "
        "ELSE '<!DOCTYPE html>' || chr(10) || html END")
    order = 0 if mode == "passive" else 1 << 30
    inline = "src = ''" if mode == "passive" else "NOT has_src"
    return f"""SELECT page_id, url, '{name}' AS source, 'html' AS kind, {order} AS source_ord, {html} AS content
        FROM ({pages})
        UNION ALL
        SELECT page_id, url, 'Inline Script #' || k, 'inline', k, body FROM (
            SELECT page_id, url, body, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k
            FROM ({script_tags(pages)}) WHERE {inline})"""


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^(https?://[^/?#]*)', 1)"


def script_refs(pages: str) -> str:
    """Enough of URL resolution for the script references of the corpora."""
    return f"""SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS ref_ord,
            CASE WHEN starts_with(src, '/') THEN {origin('url')} || src
            ELSE {origin('url')} || regexp_replace(regexp_replace(
                regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '[^/]*$', ''), '[^/]+/$', '')
                || regexp_replace(src, '^[.][.]/lib/[.]/', 'lib/') END AS script_url
        FROM ({script_tags(pages)}) WHERE src <> ''"""
