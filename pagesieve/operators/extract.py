"""Finding extractors: matches turned into validated findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.functions.text import (
    FINDING_CAPS,
    LIST_RADIUS,
    preview,
    shannon_entropy,
    snippet,
)
from pagesieve.functions.urls import base_domain, current_hostname, resolve_url, url_host
from pagesieve.operators.match import clean_group, entropy_filter, scan
from pagesieve.sources.addressed import Addressed
from pagesieve.sources.pages import (
    EXTERNAL_ORD,
    MAX_CONTENT_BYTES,
    decode_sources,
    drop_too_large,
    latest_response,
    size_gate,
    usable_response,
)

# One more than the nominal thousand: the count is compared after it is raised.
PASSIVE_MATCH_CAP = 1001


def secret_findings(
    sources: DataFrame,
    rules: Sequence[R.Rule] | None = None,
    max_matches: int | None = None,
) -> DataFrame:
    """Secrets of the passive scan: raw text, each rule with its own flags.

    ``max_matches`` caps the candidates of one rule in one source, before the
    entropy filter.  Of the two workers this mirrors one caps at
    ``PASSIVE_MATCH_CAP`` and one does not; nothing is capped by default.
    """
    return _as_findings(
        sources, entropy_filter(scan(sources, R.strict_rules() if rules is None else rules, max_matches)))


def _as_findings(sources: DataFrame, matches: DataFrame) -> DataFrame:
    large = F.col("is_too_large") if "is_too_large" in sources.columns else F.lit(False)
    extra = [c for c in ("url", "source_ord") if c in matches.columns]
    return matches.select(
        "page_id", *extra, F.col("rule_id").alias("id"), "description", F.col("finding").alias("secret"),
        "source", large.alias("is_source_too_large"), "line", "column", "rule_ord", "match_ord")


def _texts_of(refs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each usable script that some page refers to, once."""
    used = refs.select(F.col("script_url").alias("source")).distinct()
    bodies = latest_response(fetched).where(usable_response(F.col("status"), F.col("body"))).select(
        F.col("url").alias("source"), F.col("body").alias("content"))
    return bodies.join(used, "source", "left_semi")


def _to_pages(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """Matches in scripts, repeated for every page that refers to the script."""
    places = refs.select(
        "page_id", "url", F.col("script_url").alias("source"),
        (F.col("ref_ord") + F.lit(EXTERNAL_ORD)).alias("source_ord"))
    return matches.join(places, "source")


def script_findings(
    refs: DataFrame, fetched: DataFrame, rules: Sequence[R.Rule] | None = None, max_matches: int | None = None,
    max_bytes: int | None = MAX_CONTENT_BYTES,
) -> DataFrame:
    """What ``secret_findings`` gives for attached scripts, at less cost.

    Popular scripts belong to very many pages.  Each is scanned once and only
    its findings, which are few and small, are joined to the pages.
    """
    texts = size_gate(_texts_of(refs, fetched), max_bytes)
    matches = entropy_filter(scan(texts, R.strict_rules() if rules is None else rules, max_matches))
    return _as_findings(texts, _to_pages(matches, refs))


def addressed_findings(found: Addressed, rules: Sequence[R.Rule] | None = None, max_matches: int | None = None) -> DataFrame:
    """What ``secret_findings`` gives for all sources of a job; each different script is scanned once."""
    rules = R.strict_rules() if rules is None else rules
    pages = entropy_filter(scan(found.documents, rules, max_matches))
    places = found.places.where(~F.col("is_too_large"))
    scripts = entropy_filter(scan(_scanned_texts(found.texts, places), rules, max_matches)).join(places, "digest")
    return _as_findings(found.documents, pages).unionByName(_as_findings(found.places, scripts))


def addressed_occurrences(found: Addressed, rules: Sequence[R.Rule]) -> DataFrame:
    """What ``occurrences`` gives for all sources of a job; each different script is scanned once."""
    pages = clean_group(scan(found.documents.select("page_id", "url", "source", "source_ord", "content"), rules))
    scripts = clean_group(scan(_scanned_texts(found.texts, found.places), rules))
    places = found.places.select("digest", "page_id", "url", "source", "source_ord")
    return _validated(pages).unionByName(_validated(scripts.join(places, "digest")))


def _scanned_texts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(digest, content) of the texts that stand at some of the ``places``."""
    return texts.select("digest", "content").join(places.select("digest").distinct(), "digest", "left_semi")


def _related(finding: Column, url: Column) -> Column:
    host = url_host(url)
    current, base = current_hostname(host), base_domain(host)
    return F.coalesce(
        (finding == current) | finding.endswith(F.concat(F.lit("."), current))
        | (finding == base) | finding.endswith(F.concat(F.lit("."), base)),
        F.lit(False))


def occurrences(sources: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """Findings of the full scan, one row per occurrence, long form.

    ``sources`` needs ``page_id``, ``url``, ``source``, ``source_ord`` and
    ``content``; the text should be decoded already.
    """
    keep = [c for c in ("page_id", "url", "source", "source_ord", "content") if c in sources.columns]
    return _validated(clean_group(scan(sources.select(*keep), rules)))


def script_occurrences(
    refs: DataFrame, fetched: DataFrame, rules: Sequence[R.Rule], max_bytes: int | None = MAX_CONTENT_BYTES,
) -> DataFrame:
    """What ``occurrences`` gives for attached scripts; each is scanned once."""
    texts = decode_sources(drop_too_large(_texts_of(refs, fetched), max_bytes))
    return _validated(_to_pages(clean_group(scan(texts, rules)), refs))


def _validated(matches: DataFrame) -> DataFrame:
    category, finding = F.col("category"), F.col("finding")
    floor = F.col("entropy_floor")
    valid = (
        F.when(category == R.SUBDOMAINS, _related(finding, F.col("url")))
        .when(category == R.SECRETS, floor.isNull() | (shannon_entropy(finding) >= floor))
        .when(category == R.ENDPOINTS, ~finding.rlike(r"^/+\z"))
        .otherwise(F.lit(True)))
    method = F.when(category == R.ENDPOINTS, F.col("http_method"))
    key = F.when(method.isNotNull(), F.concat(F.lit("["), method, F.lit("] "), finding)).otherwise(finding)
    return matches.where(valid).select(
        "page_id", "url", "category", key.alias("display_key"), "source", "rule_id", "index",
        F.length(finding).alias("secret_length"), "line", "column", method.alias("http_method"),
        "source_ord", "rule_ord", "match_ord")


def full_secrets(sources: DataFrame) -> DataFrame:
    """Secret rules over decoded text, all of them ignoring case."""
    return occurrences(sources, [r for r in R.full_rules() if r.category == R.SECRETS])


def subdomains(sources: DataFrame) -> DataFrame:
    """Host names that belong to the page's own domain."""
    return occurrences(sources, R.category_rules(R.SUBDOMAINS))


def endpoints(sources: DataFrame, rule_ids: Sequence[str] | None = None) -> DataFrame:
    chosen = R.category_rules(R.ENDPOINTS)
    if rule_ids is not None:
        chosen = tuple(r for r in chosen if r.rule_id in set(rule_ids))
    return occurrences(sources, chosen)


def source_maps(sources: DataFrame) -> DataFrame:
    """Source map references, with the absolute URL where the source has one."""
    return with_map_urls(occurrences(sources, R.category_rules(R.SOURCE_MAPS)))


def with_map_urls(found: DataFrame) -> DataFrame:
    """Source map findings with the URL of the map."""
    absolute = resolve_url(F.col("display_key"), F.col("source"))
    return found.withColumn("map_url", F.coalesce(
        F.when(F.col("source").startswith("http"), absolute), F.col("display_key")))


def libraries(sources: DataFrame) -> DataFrame:
    return occurrences(sources, R.category_rules(R.LIBRARIES))


# Members of the sink rule, for the variant that reports both.
_SINK_PROPERTIES = ("innerHTML", "outerHTML", "src", "href", "action", "style", "cssText")
_SINK_METHODS = (
    "insertAdjacentHTML", "write", "writeln", "replace", "open", "setAttribute", "assign", "html",
    "append", "prepend", "after", "before", "parseHTML", "eval", "setTimeout", "setInterval")


def dom_sinks(sources: DataFrame, sinks: str = "assigned") -> DataFrame:
    """DOM sinks: ``assigned`` properties only, or ``all`` with method calls.

    The rule's group holds assigned properties; called methods match it with
    an empty group and drop out, so ``all`` is a variant of our own.
    """
    (rule,) = R.category_rules(R.SINKS)
    if sinks == "all":
        names, calls = "|".join(_SINK_PROPERTIES), "|".join(_SINK_METHODS)
        pattern = (
            rf"(?:\.(?=(?:{names})\b\s*=)|(?:\.|\b)(?=(?:{calls})\b\s*\())"
            r"([a-zA-Z]+)\s*[=(]")
        rule = replace(rule, pattern=pattern)
    return occurrences(sources, [rule])


def interesting_parameters(sources: DataFrame, parameters: Sequence[str] = R.DEFAULT_PARAMETERS) -> DataFrame:
    rule = R.parameter_rule(parameters)
    found = occurrences(sources, [rule or R.parameter_rule(R.DEFAULT_PARAMETERS)])
    return found if rule else found.where(F.lit(False))


def npm_packages(sources: DataFrame) -> DataFrame:
    """Scoped package names, a step towards ``dependency_confusion``."""
    return occurrences(sources, R.category_rules(R.NPM_PACKAGES))


def graphql(sources: DataFrame) -> DataFrame:
    return occurrences(sources, R.category_rules(R.GRAPHQL))


def sanitize_findings(findings: DataFrame) -> DataFrame:
    """Cap field lengths and fill defaults before findings reach a sink."""
    def capped(name: str, default: str | None) -> Column:
        value = F.col(name).cast("string")
        value = F.when(value != "", value)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        return F.substring(value, 1, FINDING_CAPS[name]).alias(name)

    def whole(name: str) -> Column:
        number = F.col(name).cast("string")
        fits = number.rlike(r"^-?[0-9]+(?:\.0+)?\z")
        return F.when(fits, number.try_cast("double").cast("int")).alias(name)

    changed = {
        "id": capped("id", "Unknown"), "description": capped("description", None),
        "source": capped("source", ""), "secret": capped("secret", ""),
        "line": whole("line"), "column": whole("column"),
        "is_source_too_large": F.coalesce(F.col("is_source_too_large"), F.lit(False)).alias("is_source_too_large"),
    }
    return findings.select(*[changed.get(c, F.col(c)) for c in findings.columns])


def with_preview(findings: DataFrame) -> DataFrame:
    return findings.withColumn("preview", preview(F.col("secret")))


def with_snippet(found: DataFrame, sources: DataFrame, radius: int = LIST_RADIUS) -> DataFrame:
    """Occurrences with the text around them.

    The text comes back by a join on page and source, so ask for snippets of
    the findings that are shown, not of the whole table.
    """
    texts = sources.select("page_id", "source", "content")
    around = snippet(F.col("content"), F.col("index"), F.col("secret_length"), radius)
    return found.join(texts, ["page_id", "source"]).withColumn("snippet", around).drop("content")
