"""From pages to the texts that are scanned."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions.patterns import user_pattern
from pagesieve.functions.text import decode_entities, decode_text, let, with_doctype
from pagesieve.functions.urls import is_scannable, resolve_url
from pagesieve.sources.layout import spread, tasks_for

MAX_CONTENT_BYTES = 5 * 1024 * 1024

PASSIVE, FULL = "passive", "full"

# Source names of the two scan modes.
HTML_SOURCE = {PASSIVE: "HTML Document", FULL: "Main HTML Document"}
INLINE_PREFIX = "Inline Script #"

# External scripts come after inline ones and before the page of a full scan.
EXTERNAL_ORD, LAST_ORD = 1 << 20, 1 << 30

# Scripts are found the way an HTML parser finds them: comments and elements
# whose content is plain text are stepped over, the first close tag ends a
# script, and what is never closed runs to the end, so no part is read twice.
_ATTRS = r"""((?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+)"""
_SCRIPTS = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    r"|<(style|textarea|title|xmp|iframe|noembed|noframes|noscript)(?=[\s/>])" + _ATTRS + r"(?:>.*?(?:</\1(?=[\s/>])|\z)|\z)"
    r"|<script(?=[\s/>])" + _ATTRS + r"(?:>.*?(?:</script(?=[\s/>])[^>]*>|\z)|\z)"
    r"|<base(?=[\s/>])" + _ATTRS + r"(?:>|\z)"
)
_OPENED = r"(?is)^<script(?=[\s/>])" + _ATTRS + ">"
_ONE_SCRIPT = _OPENED + r"(.*?)(?:</script(?=[\s/>])[^>]*>|\z)"
_ATTR = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?"""


def read_pages(spark: SparkSession, folder: str, name: str = "pages.parquet") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}").select("page_id", "url", "html")


def exclusion_test(url: Column, patterns: Sequence[str]) -> Column | None:
    """True for URLs a line of the list hits; null when no line is usable.

    A line between slashes is a regex, any other a substring in any case.
    Blank lines and regexes that do not compile are skipped.
    """
    tests = []
    for line in patterns:
        if not line.strip():
            continue
        # A lone slash opens and closes nothing: the empty regex, which hits all.
        if line.startswith("/") and line.endswith("/"):
            try:
                pattern = user_pattern(line[1:-1])
            except ValueError:
                continue
            tests.append(url.rlike(pattern))
        else:
            tests.append(F.lower(url).contains(line.lower()))
    if not tests:
        return None
    hit = tests[0]
    for test in tests[1:]:
        hit = hit | test
    return hit


def exclude_urls(pages: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop excluded URLs with one predicate, which Spark moves below the scan."""
    hit = exclusion_test(F.col("url"), patterns)
    return pages if hit is None else pages.where(~F.coalesce(hit, F.lit(False)))


def scannable(pages: DataFrame, exclusions: Sequence[str] = ()) -> DataFrame:
    return exclude_urls(pages.where(is_scannable(F.col("url"))), exclusions)


def main_frame(nav_events: DataFrame, exclusions: Sequence[str] = ()) -> DataFrame:
    """Completed navigations of the page itself; works on batches and streams."""
    return scannable(nav_events.where(F.col("frame_id") == 0), exclusions)


def _elements(html: Column) -> Column:
    """Array of the elements of a page that matter here, in document order, in one walk."""
    low = F.lower(html)
    return F.when(low.contains("<script") | low.contains("<base"), F.regexp_extract_all(html, F.lit(_SCRIPTS), F.lit(0)))


def _scripts_of(elements: Column) -> Column:
    """Array of (attributes, body) of the script elements among ``elements``."""
    # A tag that is not closed itself is no element.
    scripts = F.filter(elements, lambda e: (F.lower(F.substring(e, 1, 7)) == "<script") & e.rlike(_OPENED))
    return F.transform(scripts, lambda e: F.struct(
        F.regexp_extract(e, _ONE_SCRIPT, 1).alias("attrs"),
        F.regexp_extract(e, _ONE_SCRIPT, 2).alias("body")))


def _script_tags(html: Column) -> Column:
    """Array of (attributes, body) of the script elements in document order."""
    return F.when(F.lower(html).contains("<script"), let(_elements(html), _scripts_of))


def _base_of(elements: Column) -> Column:
    """The first ``href`` of a base element among ``elements``, null when there is none."""
    tags = F.filter(elements, lambda e: (F.lower(F.substring(e, 1, 5)) == "<base") & e.endswith(">"))
    hrefs = F.transform(tags, lambda e: _attribute(F.regexp_extract(e, r"(?is)^<base(?=[\s/>])" + _ATTRS + ">", 1), "href"))
    return F.get(F.filter(hrefs, lambda href: href.isNotNull()), F.lit(0))


def _src(attrs: Column) -> Column:
    return _attribute(attrs, "src")


def _attribute(attrs: Column, name: str) -> Column:
    """Value of the first attribute of a name, null when there is none."""
    names = F.transform(F.regexp_extract_all(attrs, F.lit(_ATTR), F.lit(1)), F.lower)
    values = F.zip_with(
        F.regexp_extract_all(attrs, F.lit(_ATTR), F.lit(2)),
        F.zip_with(
            F.regexp_extract_all(attrs, F.lit(_ATTR), F.lit(3)),
            F.regexp_extract_all(attrs, F.lit(_ATTR), F.lit(4)),
            lambda a, b: F.concat(a, b)),
        lambda a, b: F.concat(a, b))
    at = F.array_position(names, name).cast("int")
    found = let(at, lambda i: F.when(i > 0, F.element_at(values, F.greatest(i, F.lit(1)))))
    return F.when(F.lower(attrs).contains(name), decode_entities(found))


def _based(href: Column, url: Column) -> Column:
    return F.when(F.coalesce(href, F.lit("")) != "", F.coalesce(resolve_url(href, url), url)).otherwise(url)


def base_url(html: Column, url: Column) -> Column:
    """Base for relative links: the first ``<base href>``, else the page itself."""
    href = F.when(F.lower(html).contains("<base"), let(_elements(html), _base_of))
    return _based(href, url)


def _inline_scripts(mode: str) -> Callable[[Column], Column]:
    def inline(tags: Column) -> Column:
        def is_inline(tag: Column) -> Column:
            src = _src(tag["attrs"])
            return F.coalesce(src, F.lit("")) == "" if mode == PASSIVE else src.isNull()

        kept = F.filter(tags, is_inline)
        return F.transform(kept, lambda tag, i: F.struct(
            F.concat(F.lit(INLINE_PREFIX), (i + F.lit(1)).cast("string")).alias("source"),
            F.lit("inline").alias("kind"),
            (i + F.lit(1)).alias("source_ord"),
            tag["body"].alias("content")))

    return inline


def _page_row(mode: str, add_doctype: bool) -> Column:
    """The page itself; the passive scan begins with it, the full one ends with it."""
    html = with_doctype(F.col("html")) if mode == FULL and add_doctype else F.col("html")
    return F.array(F.struct(
        F.lit(HTML_SOURCE[mode]).alias("source"), F.lit("html").alias("kind"),
        F.lit(0 if mode == PASSIVE else LAST_ORD).alias("source_ord"), html.alias("content")))


def extract_sources(pages: DataFrame, mode: str = PASSIVE, add_doctype: bool = True) -> DataFrame:
    """One row for the HTML of a page and one for each inline script.

    The passive scan counts a script with an empty ``src`` as inline, the full
    scan counts only scripts without the attribute.  The HTML still holds the
    inline scripts, so both report a match: that is intended.
    """
    page_row = _page_row(mode, add_doctype)
    scripts = let(_script_tags(F.col("html")), _inline_scripts(mode))
    rows = F.concat(page_row, F.coalesce(scripts, F.slice(page_row, 1, 0)))
    return spread(pages, ["page_id"]).select("page_id", "url", F.inline(rows))


def parse_pages(pages: DataFrame, mode: str = PASSIVE, add_doctype: bool = True) -> DataFrame:
    """Everything a job needs of its pages, in one walk over each.

    Rows are the sources as ``extract_sources`` gives them, of kind ``ref`` the
    absolute URLs of external scripts as ``script_refs`` does (in ``content``), and of kind
    ``next`` the build data of the page (full mode only).
    """
    def refs(els: Column) -> Column:
        found = F.filter(F.transform(_scripts_of(els), lambda t: _src(t["attrs"])), lambda s: F.coalesce(s, F.lit("")) != "")
        return let(_base_of(els), lambda base: F.transform(found, lambda src, i: F.struct(
            base.alias("source"), F.lit("ref").alias("kind"), i.alias("source_ord"), src.alias("content"))))

    def parsed(els: Column) -> Column:
        return F.concat(_inline_scripts(mode)(_scripts_of(els)), refs(els))

    page_row = _page_row(mode, add_doctype)
    none = F.slice(page_row, 1, 0)
    data = F.array(F.struct(
        F.lit(None).cast("string").alias("source"), F.lit("next").alias("kind"), F.lit(0).alias("source_ord"),
        next_data(F.col("html")).alias("content"))) if mode == FULL else none
    rows = F.concat(page_row, F.coalesce(let(_elements(F.col("html")), parsed), none), F.when(has_next_data(F.col("html")), data).otherwise(none))
    found = spread(pages, ["page_id"]).select("page_id", "url", F.inline(rows))
    is_ref = F.col("kind") == "ref"
    target = resolve_url(F.col("content"), _based(F.col("source"), F.col("url")), keep_fragment=True)
    return found.withColumn("content", F.when(is_ref, target).otherwise(F.col("content"))).withColumn(
        "source", F.when(~is_ref, F.col("source"))).where(~is_ref | F.col("content").isNotNull())


# The element in which a page carries its build data.
_NEXT_TAG = '<script id="__NEXT_DATA__"'
_NEXT_DATA = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.+?)</script>'


def has_next_data(html: Column) -> Column:
    return F.coalesce(html.contains(_NEXT_TAG), F.lit(False))


def next_data(html: Column) -> Column:
    return F.regexp_extract(html, _NEXT_DATA, 1)


def script_refs(pages: DataFrame) -> DataFrame:
    """Absolute URLs of the external scripts of a page, in document order."""
    def refs(tags: Column) -> Column:
        return F.filter(F.transform(tags, lambda t: _src(t["attrs"])), lambda s: F.coalesce(s, F.lit("")) != "")

    found = spread(pages, ["page_id"]).select(
        "page_id", "url", base_url(F.col("html"), F.col("url")).alias("_base"),
        F.posexplode(let(_script_tags(F.col("html")), refs)).alias("ref_ord", "_src"))
    return found.select(
        "page_id", "url", "ref_ord", resolve_url(F.col("_src"), F.col("_base"), keep_fragment=True).alias("script_url")
    ).where(F.col("script_url").isNotNull())


def usable_response(status: Column, body: Column) -> Column:
    return status.between(200, 299) & (F.coalesce(body, F.lit("")) != "")


def latest_response(fetched: DataFrame, method: str = "GET") -> DataFrame:
    """One observation per URL: the newest usable one of a method, else the newest of it.

    Crawls see a URL again and probe it with HEAD; only one record may stand for
    it.  Tables without a method or a time count as of that method and of one time.

    Bodies are sorted to find the newest, so they are spread over as many tasks as
    they need, first by whole rows: a URL seen over and over costs a row per task.
    """
    own = fetched.where(F.upper("method") == method) if "method" in fetched.columns else fetched
    times = [F.col(c) for c in ("fetched_at", "ts") if c in fetched.columns][:1]
    place = [usable_response(F.col("status"), F.col("body")).alias("_usable"), *times, F.col("status"), F.col("body")]
    # One struct is both the order and the row, so that a body is moved once.
    named = ["_usable", *[c for c in ("fetched_at", "ts") if c in fetched.columns][:1], "status", "body"]
    rest = [c for c in fetched.columns if c != "url"]
    row = F.struct(*place, *[F.col(c) for c in rest if c not in named]).alias("_row")
    tasks = tasks_for(own, text=F.col("body"))
    rows = own.select("url", row, F.pmod(F.xxhash64(*own.columns), F.lit(tasks)).alias("_share")).repartition(tasks, "_share")
    shares = rows.groupBy("_share", "url").agg(F.max("_row").alias("_row"))
    newest = shares.repartition(tasks, "url").groupBy("url").agg(F.max("_row").alias("_row"))
    return newest.select("url", *[F.col("_row")[c].alias(c) for c in rest])


def attach_scripts(sources: DataFrame, refs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Add the bodies of external scripts that were fetched with success.

    Every page gets its own copy of a script.  To find what popular scripts
    hold, ``extract.script_findings`` scans each of them once instead.
    """
    bodies = latest_response(fetched).where(usable_response(F.col("status"), F.col("body"))).select(
        F.col("url").alias("script_url"), F.col("body").alias("content"))
    scripts = refs.join(bodies, "script_url").select(
        "page_id", "url", F.col("script_url").alias("source"), F.lit("external").alias("kind"),
        (F.col("ref_ord") + F.lit(EXTERNAL_ORD)).alias("source_ord"), "content")
    return sources.unionByName(scripts)


def size_gate(sources: DataFrame, max_bytes: int | None = MAX_CONTENT_BYTES) -> DataFrame:
    """Flag texts that are too large to scan; they stay listed.  None scans all."""
    size = F.octet_length("content").cast("bigint")
    large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    return sources.withColumn("n_bytes", size).withColumn("is_too_large", large)


def drop_too_large(sources: DataFrame, max_bytes: int | None = MAX_CONTENT_BYTES) -> DataFrame:
    """The full scan forgets texts that are too large, or empty.  None forgets the empty only."""
    filled = sources.where(F.coalesce(F.col("content"), F.lit("")) != "")
    return filled if max_bytes is None else filled.where(F.octet_length("content") <= max_bytes)


def decode_sources(sources: DataFrame) -> DataFrame:
    """Decoded texts, for the full scan."""
    return sources.withColumn("content", decode_text(F.col("content")))


def label_sources(sources: DataFrame) -> DataFrame:
    """Language of a source by its name."""
    source = F.col("source")
    return sources.withColumn(
        "language",
        F.when(source.endswith(".js"), "javascript")
        .when(source.endswith(".css"), "css")
        .when(source.endswith(".json"), "json")
        .when(source.endswith(".html") | (source == HTML_SOURCE[PASSIVE]), "markup")
        .otherwise("javascript"))


def external_script_inventory(sources: DataFrame) -> DataFrame:
    """Sources that are neither the page nor an inline script, once per page."""
    external = (F.col("source") != HTML_SOURCE[FULL]) & ~F.col("source").startswith("Inline Script")
    return sources.where(external).select("page_id", "source").distinct()


def inline_script_inventory(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("source").startswith("Inline Script")).select("page_id", "source")
