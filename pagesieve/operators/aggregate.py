"""Counts and groups over findings.

Every aggregate combines partially before its shuffle, so a page or key that
holds much of the table costs one row per task.  Where rows themselves are
collected, groups are cut into parts of bounded size first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.functions.urls import url_host
from pagesieve.sources.addressed import materialize
from pagesieve.sources.pages import HTML_SOURCE

_KEY = ("page_id", "category", "display_key")
# Place of an occurrence in the scan: sources, then rules, then matches.
_ORDER = ("source_ord", "rule_ord", "match_ord")

OCCURRENCES_PER_PART = 100_000
# Large groups of which the sizes may be sent to every executor.
BROADCAST_GROUPS = 1_000_000


def _order() -> Column:
    return F.struct(*[F.col(c) for c in _ORDER])


def split_large(rows: DataFrame, keys: list[str], spread_by: list[str], per_part: int) -> DataFrame:
    """Number parts so that no (keys, part) holds much more than ``per_part`` rows.

    Groups are counted first; rows of a group within the limit all get part 0. Rows
    are not moved for it unless very many groups are large.
    """
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_part), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes
    parts = F.ceil(F.col("_n") / F.lit(per_part)).cast("bigint")
    numbered = rows.join(sizes, keys, "left")
    part = F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    return numbered.withColumn("part", F.coalesce(part, F.lit(0))).drop("_n")


_FIELDS = ("source", "rule_id", "index", "secret_length", "line", "column", "http_method")


def in_scan_order() -> Column:
    """Aggregate: the occurrences of a group as an array, in the order of the scan."""
    rows = F.sort_array(F.collect_list(F.struct(_order().alias("ord"), *[F.col(f) for f in _FIELDS])))
    return F.transform(rows, lambda o: F.struct(*[o[f].alias(f) for f in _FIELDS]))


def group_findings(found: DataFrame, per_part: int = OCCURRENCES_PER_PART) -> DataFrame:
    """Occurrences as an array under page, category and key, in scan order."""
    parts = split_large(found, list(_KEY), ["source", "index", "rule_ord"], per_part)
    return parts.groupBy(*_KEY, "part").agg(in_scan_order().alias("occurrences"))


def unique_occurrences(found: DataFrame) -> DataFrame:
    """One row per key, source and offset; of several the last stands."""
    at = (*_KEY, "source", "index")
    rest = [c for c in found.columns if c not in at]
    last = found.groupBy(*at).agg(F.max_by(F.struct(*rest), _order()).alias("_last"))
    return last.select(*at, "_last.*")


def section_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("page_id", "category").agg(F.count_distinct("display_key").alias("n_keys"))


def secrets_by_rule(found: DataFrame) -> DataFrame:
    """Secrets per rule; a secret counts for the rule that found it first."""
    secrets = found.where(F.col("category") == R.SECRETS)
    first = secrets.groupBy("page_id", "display_key").agg(
        F.min_by(F.struct("rule_id"), _order()).alias("_first"))
    rule = F.coalesce(F.col("_first.rule_id"), F.lit("generic-secret"))
    return first.groupBy("page_id", rule.alias("rule_id")).agg(F.count(F.lit(1)).alias("n_secrets"))


def page_totals(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys of a page over all categories, its scripts among them.

    Package names are an intermediate result and do not count.
    """
    keys = found.where(F.col("category") != R.NPM_PACKAGES).groupBy("page_id").agg(
        F.count_distinct("category", "display_key").alias("n"))
    scripts = sources.where(F.col("source") != HTML_SOURCE["full"]).groupBy("page_id").agg(
        F.count_distinct("source").alias("n"))
    return keys.unionByName(scripts).groupBy("page_id").agg(F.sum("n").alias("total"))


def page_status(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Badge of a page: how many finding rows, and whether any."""
    counts = findings.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return pages.select("page_id", "url").join(counts, "page_id", "left").select(
        "page_id", "url", n.alias("n_findings"), F.when(n > 0, "found").otherwise("clean").alias("status"))


def section_items(found: DataFrame) -> DataFrame:
    """The distinct items a section lists."""
    return found.select("page_id", "category", F.col("display_key").alias("item")).distinct()


def _is_local(source: Column) -> Column:
    return source.startswith("Inline") | source.isin(*HTML_SOURCE.values())


def retain_sources(sources: DataFrame, found: DataFrame, mode: str = "passive") -> DataFrame:
    """Which texts are worth keeping after a scan.

    Passive: of pages with findings, the local texts and those with findings.
    Full: every source stays listed, only useful ones with their text.
    """
    hit = found.select("page_id", "source").distinct()
    local = _is_local(F.col("source"))
    if mode == "passive":
        pages = found.select("page_id").distinct()
        return sources.where(local).join(pages, "page_id", "left_semi").unionByName(
            sources.where(~local).join(hit, ["page_id", "source"], "left_semi"))
    flagged = sources.join(hit.withColumn("_hit", F.lit(True)), ["page_id", "source"], "left")
    kept = F.when(F.col("_hit").isNotNull() | local, F.col("content"))
    return flagged.withColumn("content", kept).drop("_hit")


def rollup_findings(found: DataFrame) -> DataFrame:
    """Occurrences and pages by category, host and rule with all subtotals."""
    per_page = found.groupBy(
        "category", url_host(F.col("url")).alias("host"), "rule_id", "page_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_page.rollup("category", "host", "rule_id").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_occurrences"),
        F.count_distinct("page_id").alias("n_pages"))
