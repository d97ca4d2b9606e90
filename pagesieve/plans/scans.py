"""The three jobs: passive scan, full scan, and rebuilding of sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.operators import aggregate, enrich, extract
from pagesieve.sources import pages as P
from pagesieve.sources import sinks
from pagesieve.sources.addressed import address, materialize


@dataclass(frozen=True)
class PassiveScan:
    sources: DataFrame
    findings: DataFrame
    status: DataFrame
    retained: DataFrame


def passive_scan(
    pages: DataFrame, fetched: DataFrame | None = None, exclusions: Sequence[str] = (),
    excluded_rule_ids: Sequence[str] = (), max_matches: int | None = None, max_bytes: int | None = P.MAX_CONTENT_BYTES,
) -> PassiveScan:
    """Secrets per source and the badge of each page; texts above ``max_bytes`` are listed unscanned, None scans all.

    Pages are walked once, each different script is scanned once, and texts are
    joined to places only where ``sources`` or ``retained`` are read.
    """
    wanted = P.scannable(pages, exclusions)
    held = address(wanted, fetched, P.PASSIVE, max_bytes)
    findings = materialize(extract.addressed_findings(held, R.strict_rules(excluded_rule_ids), max_matches), "findings")
    kept = held.with_text(aggregate.retain_sources(held.places, findings))
    return PassiveScan(
        held.sources(), findings, aggregate.page_status(findings, wanted),
        aggregate.retain_sources(held.documents, findings).unionByName(kept))


@dataclass(frozen=True)
class FullScan:
    sources: DataFrame
    occurrences: DataFrame
    reports: DataFrame


def full_scan(
    pages: DataFrame, fetched: DataFrame | None = None, registry: DataFrame | None = None,
    parameters: Sequence[str] = R.DEFAULT_PARAMETERS, guess_source_maps: bool = False, max_bytes: int | None = P.MAX_CONTENT_BYTES,
) -> FullScan:
    """Everything the on-demand report shows, for every page of a corpus."""
    rules = R.full_rules(parameters)
    held = address(pages, fetched, P.FULL, max_bytes)
    found = materialize(extract.addressed_occurrences(held, rules), "occurrences")

    manifests = enrich.manifests_of(held.build_data)
    if fetched is not None:
        if guess_source_maps:
            known = found.where(F.col("category") == R.SOURCE_MAPS)
            valid = enrich.validate_maps(enrich.guess_maps(held.places, known), fetched)
            found = enrich.merge_maps(found, valid)
        found = enrich.merge_routes(found, manifests, enrich.next_routes(manifests, fetched))
    if registry is not None:
        packages = found.where(F.col("category") == R.NPM_PACKAGES)
        found = found.unionByName(enrich.dependency_confusion(packages, registry).select(*found.columns))
    found = materialize(found.where(F.col("category") != R.NPM_PACKAGES), "found")

    # hashes stand for the texts of scripts until it is known which are shown
    marked = aggregate.retain_sources(held.places.withColumn("content", F.col("digest")).drop("digest"), found, P.FULL)
    kept = held.with_text(marked.withColumnRenamed("content", "digest")).unionByName(aggregate.retain_sources(held.documents, found, P.FULL))
    kept = kept.select("page_id", "source", "content")
    if fetched is not None:
        kept = kept.unionByName(enrich.manifest_sources(manifests, fetched))
    return FullScan(held.sources(), found, sinks.page_reports(pages, found, kept))


@dataclass(frozen=True)
class Rebuild:
    files: DataFrame
    tree: DataFrame
    dumps: DataFrame


def rebuild(maps: DataFrame, fetched: DataFrame) -> Rebuild:
    files = materialize(enrich.rebuild_sources(maps, fetched), "rebuilt")
    good = files.where(F.col("source_path") != enrich.ERROR_PATH)
    return Rebuild(files, enrich.source_tree(good), sinks.source_dumps(files))
