"""Reports and tables the scans are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.functions.text import let
from pagesieve.functions.urls import report_name
from pagesieve.operators.aggregate import in_scan_order, split_large
from pagesieve.operators.enrich import ERROR_PATH
from pagesieve.sources.layout import tasks_for
from pagesieve.sources.pages import HTML_SOURCE

OCCURRENCES_PER_REPORT = 100_000
# A text is at most 5 MiB once past the size gate, so a part stays under 256 MiB.
TEXTS_PER_REPORT = 50
FILES_PER_DUMP = 5000

_OCC = "struct<source:string,rule_id:string,index:int,secret_length:int,line:int,column:int,http_method:string>"
_FINDINGS = f"map<string,map<string,array<{_OCC}>>>"


def _script_sections(texts: DataFrame) -> DataFrame:
    """The script inventories, which a report lists as keys without occurrences."""
    source = F.col("source")
    section = F.when(source.startswith("Inline Script"), R.INLINE_SCRIPTS).otherwise(R.EXTERNAL_SCRIPTS)
    return texts.where(~source.isin(*HTML_SOURCE.values())).select(
        "page_id", "part", section.alias("category"), source.alias("display_key")
    ).distinct().withColumn("occurrences", F.array().cast(f"array<{_OCC}>"))


def _last_of_each(rows: Column) -> Column:
    """Of entries with one key, in order, the last; a page may load a script twice."""
    return F.filter(rows, lambda e, i: ~F.coalesce(
        F.get(rows, i + F.lit(1))["source"] == e["source"], F.lit(False)))


def page_reports(pages: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """One JSON report per page: findings by category and key, and the texts.

    A page with more than a report can hold is written as several parts, which
    add up to the whole; every other page has the single part 0.
    """
    shown = split_large(
        found.where(F.col("category") != R.NPM_PACKAGES), ["page_id"],
        ["category", "display_key", "source", "index"], OCCURRENCES_PER_REPORT)
    texts = split_large(sources.select("page_id", "source", "content"), ["page_id"], ["source"], TEXTS_PER_REPORT)
    by_key = shown.groupBy("page_id", "part", "category", "display_key").agg(
        in_scan_order().alias("occurrences")).unionByName(_script_sections(texts))
    by_category = by_key.groupBy("page_id", "part", "category").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("display_key", "occurrences")))).alias("keys"))
    findings = by_category.groupBy("page_id", "part").agg(
        F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("category", "keys")),
            lambda a, b: F.when(a["category"] < b["category"], -1).when(a["category"] > b["category"], 1).otherwise(0),
        )).alias("findings"))
    by_source = F.sort_array(F.collect_list(F.struct("source", "content")))
    texts = texts.groupBy("page_id", "part").agg(
        F.map_from_entries(let(by_source, _last_of_each)).alias("sources"))
    joined = findings.join(texts, ["page_id", "part"], "full_outer")
    named = pages.select("page_id", report_name(F.col("url")).alias("report_name"))
    body = F.struct(
        F.coalesce("findings", F.from_json(F.lit("{}"), _FINDINGS)).alias("findings"),
        F.coalesce("sources", F.from_json(F.lit("{}"), "map<string,string>")).alias("sources"))
    return named.join(joined, "page_id", "left").select(
        "page_id", "report_name", F.coalesce("part", F.lit(0)).alias("part"),
        F.to_json(body, {"ignoreNullFields": "true"}).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def source_dumps(rebuilt: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """One JSON dump per source map with its rebuilt files; failed maps have none.

    Texts move once, into as many tasks as they need.
    """
    good = rebuilt.where(F.col("source_path") != ERROR_PATH)
    good = good.repartition(tasks_for(good, text=F.col("content")), "map_url")
    files = split_large(good, ["map_url"], ["source_path"], FILES_PER_DUMP)
    grouped = files.groupBy("map_url", "part").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_path", "content")))).alias("sources"))
    stamp = F.current_timestamp() if extracted_at is None else extracted_at
    name = F.substring_index("map_url", "/", -1)
    return grouped.select(
        "map_url", "part", "file_count",
        F.concat(F.when(name == "", "source-map").otherwise(name), F.lit("-dump.json")).alias("dump_name"),
        F.to_json(F.struct(
            F.struct(
                F.col("map_url").alias("url"),
                F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("extractedAt"),
                F.col("file_count").alias("fileCount")).alias("metadata"),
            F.col("sources"))).alias("dump"))


def write_source_dump(dumps: DataFrame, path: str) -> None:
    dumps.write.mode("overwrite").json(path)


def safe_findings(findings: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Findings fit for a shared table: a hash and a hint instead of the secret."""
    hashed = findings.withColumn("secret_sha256", F.sha2("secret", 256)).withColumn(
        "secret_length", F.length("secret")).withColumn(
        "secret_hint", F.when(F.length("secret") > 12, F.concat(F.substring("secret", 1, 4), F.lit("..."))))
    return hashed if keep_raw else hashed.drop("secret")


def write_findings(findings: DataFrame, path: str, keep_raw: bool = False, run: str | None = None) -> None:
    """Add to the findings table, one folder per day of scan and category.

    A ``run`` has a folder of its own above these; one that is repeated replaces
    what it wrote. Without it rows are appended, by a repeated job too.
    """
    rows = safe_findings(findings, keep_raw)
    if "scan_date" not in rows.columns:
        rows = rows.withColumn("scan_date", F.current_date())
    if "category" not in rows.columns:
        rows = rows.withColumn("category", F.lit(R.SECRETS))
    target, mode = (path, "append") if run is None else (f"{path}/run={run}", "overwrite")
    rows.write.mode(mode).partitionBy("scan_date", "category").parquet(target)
