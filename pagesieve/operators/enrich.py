"""Joins of findings with what a crawler has recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagesieve import rules as R
from pagesieve.functions.text import let
from pagesieve.functions.urls import normalize_url, resolve_url, url_host, url_origin
from pagesieve.sources.addressed import materialize
from pagesieve.sources.layout import TASK_ROWS, tasks_for
from pagesieve.sources.pages import has_next_data, latest_response, next_data, usable_response

# Sizes in bytes a probed source map may state.
MAP_MIN_BYTES, MAP_MAX_BYTES = 50, 50 * 1024 * 1024
GUESS_SOURCE, GUESS_RULE = "Heuristic (Guessed)", "guessed-source-map"

ERROR_PATH = "rebuild.error.log"


def dependency_confusion(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Packages the public registry does not know.

    Only a recorded 404 counts; a name without a record is not flagged.
    """
    missing = registry.where(F.col("status") == 404).select(F.col("package").alias("display_key"))
    return packages.join(missing, "display_key", "left_semi").withColumn(
        "category", F.lit(R.DEPENDENCY_CONFUSION))


def _plain(url: Column) -> Column:
    """URL without fragment; text that is no absolute URL stays as it is."""
    return F.coalesce(normalize_url(url), url)


def guess_maps(sources: DataFrame, known_maps: DataFrame) -> DataFrame:
    """Likely source map URLs of fetched scripts, minus the maps a page names.

    A known map that is relative is compared as it stands and so does not
    suppress the absolute guess.
    """
    scripts = sources.where(F.col("source").startswith("http") & F.col("source").endswith(".js"))
    guesses = scripts.select(
        "page_id", F.concat(_plain(F.col("source")), F.lit(".map")).alias("map_url")).distinct()
    known = known_maps.select("page_id", _plain(F.col("display_key")).alias("map_url"))
    return guesses.join(known, ["page_id", "map_url"], "left_anti")


def looks_like_map(status: Column, content_type: Column, content_length: Column) -> Column:
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html")
    length = F.coalesce(content_length, F.lit(0))
    size_ok = (length <= 0) | length.between(MAP_MIN_BYTES, MAP_MAX_BYTES)
    return (status == 200) & ~html & size_ok


def validate_maps(guesses: DataFrame, fetched: DataFrame) -> DataFrame:
    """Guesses whose newest probe looks like a source map.

    A probe is a HEAD request; a URL that was never probed is judged by its newest
    GET.  A newer answer withdraws an older one.
    """
    probes = latest_response(fetched, "HEAD")
    if "method" in fetched.columns:
        probes = probes.unionByName(latest_response(fetched).join(probes.select("url"), "url", "left_anti"))
    good = probes.where(
        looks_like_map(F.col("status"), F.col("content_type"), F.col("content_length"))
    ).select(F.col("url").alias("map_url"))
    return guesses.join(good, "map_url", "left_semi").select("page_id", "map_url")


_OCCURRENCE = (
    "page_id", "category", "display_key", "source", "rule_id", "index", "secret_length", "line", "column")


def merge_maps(found: DataFrame, valid: DataFrame) -> DataFrame:
    """Source map findings with the guesses that proved right added."""
    known = found.where(F.col("category") == R.SOURCE_MAPS).select(
        "page_id", _plain(F.col("display_key")).alias("_plain"))
    new = valid.withColumn("_plain", _plain(F.col("map_url"))).join(
        known, ["page_id", "_plain"], "left_anti").dropDuplicates(["page_id", "map_url"])
    zero = F.lit(0)
    rows = new.select(
        "page_id", F.lit(R.SOURCE_MAPS).alias("category"), F.col("map_url").alias("display_key"),
        F.lit(GUESS_SOURCE).alias("source"), F.lit(GUESS_RULE).alias("rule_id"), zero.alias("index"),
        zero.alias("secret_length"), zero.alias("line"), zero.alias("column"))
    return found.unionByName(rows, allowMissingColumns=True)


def next_manifests(pages: DataFrame) -> DataFrame:
    """Build id and manifest URL of pages that carry Next.js data."""
    return manifests_of(pages.where(has_next_data(F.col("html"))).select("page_id", "url", next_data(F.col("html")).alias("content")))


def manifests_of(build_data: DataFrame) -> DataFrame:
    """Build id and manifest URL from the build data of pages (``page_id``, ``url``, ``content``)."""
    data = build_data.select("page_id", "url", F.try_parse_json("content").alias("_data"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_data", path, "variant"))

    build = F.try_variant_get("_data", "$.buildId", "string")
    prefix = F.try_variant_get("_data", "$.assetPrefix", "string")
    prefix_kind = kind("$.assetPrefix")
    no_prefix = prefix_kind.isNull() | (prefix_kind == "VOID") | prefix.isin("", "false", "0")
    base = F.when(no_prefix, F.when(url_host(F.col("url")) != "", url_origin(F.col("url")))).when(
        prefix_kind == "STRING", prefix)
    manifest = F.concat(
        F.regexp_replace(base, r"/\z", ""), F.lit("/_next/static/"), build, F.lit("/_buildManifest.js"))
    ok = (kind("$.buildId") == "STRING") & (build != "")
    return data.where(ok).select(
        "page_id", build.alias("build_id"), manifest.alias("manifest_url")
    ).where(F.col("manifest_url").isNotNull())


def next_routes(manifests: DataFrame, fetched: DataFrame) -> DataFrame:
    """Routes named by fetched build manifests, internal and catch-all ones left out."""
    bodies = latest_response(fetched).where(usable_response(F.col("status"), F.col("body"))).select(
        F.col("url").alias("manifest_url"), "body")
    routes = F.regexp_extract_all(F.col("body"), F.lit(r'"(/[^"]*)"[\s]*:'), F.lit(1))
    found = bodies.join(
        manifests.select("manifest_url").distinct(), "manifest_url", "left_semi"
    ).select("manifest_url", F.posexplode(routes).alias("route_ord", "route"))
    route = F.col("route")
    return found.where(~route.startswith("/_") & ~route.contains("[..."))


def manifest_sources(manifests: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched build manifests as sources of their pages, for the report."""
    bodies = latest_response(fetched).where(usable_response(F.col("status"), F.col("body"))).select(
        F.col("url").alias("source"), F.col("body").alias("content"))
    return manifests.select("page_id", F.col("manifest_url").alias("source")).join(bodies, "source")


def merge_routes(found: DataFrame, manifests: DataFrame, routes: DataFrame) -> DataFrame:
    """Endpoints with the routes added that the page did not show itself."""
    per_page = manifests.join(routes, "manifest_url").select(
        "page_id", "manifest_url", F.col("route").alias("display_key")
    ).dropDuplicates(["page_id", "display_key"])
    known = found.where(F.col("category") == R.ENDPOINTS).select("page_id", "display_key")
    rows = per_page.join(known, ["page_id", "display_key"], "left_anti").select(
        "page_id", F.lit(R.ENDPOINTS).alias("category"), "display_key",
        F.col("manifest_url").alias("source"), F.lit(0).alias("index"),
        F.lit(1).alias("line"), F.lit(1).alias("column"))
    return found.unionByName(rows, allowMissingColumns=True)


def rebuild_sources(maps: DataFrame, fetched: DataFrame) -> DataFrame:
    """Original sources of source maps: ``map_url, source_path, content, origin``.

    Text embedded in the map comes first, then the fetched file; a file whose
    fetch failed is named as missing, one without any record is left out.  A
    map that cannot be used gives one row under ``ERROR_PATH``.

    Bodies are never sent to all executors: both sides of a join are spread over
    as many tasks as they need, and a file that many maps name over several.
    """
    answers = materialize(latest_response(fetched).select("url", "status", "body"), "answers")
    tasks = max(tasks_for(answers, text=F.col("body")), tasks_for(maps))
    by_url = answers.repartition(tasks, "url").hint("merge")
    listed = maps.select("map_url").repartition(tasks, "map_url").distinct()
    files = listed.join(by_url, listed.map_url == by_url.url, "left")
    ok = F.col("status").between(200, 299)
    parsed = F.when(ok, F.from_json("body", "struct<sources:array<string>,sourcesContent:array<string>>"))

    def entries(m: Column) -> Column:
        listed = F.transform(m["sources"], lambda path, i: F.struct(
            path.alias("path"), i.alias("pos"), F.coalesce(F.get(m["sourcesContent"], i), F.lit("")).alias("text")))
        ranked = F.array_sort(F.filter(listed, lambda e: e["path"].isNotNull()))
        # Of equal paths the last one stands.
        return let(ranked, lambda r: F.filter(r, lambda e, i: ~F.coalesce(
            F.get(r, i + F.lit(1))["path"] == e["path"], F.lit(False))))

    reason = (
        F.when(F.col("status").isNull(), F.lit("Error: the source map was not fetched"))
        .when(~ok, F.concat(F.lit("Error: HTTP status "), F.col("status").cast("string")))
        .otherwise(F.lit("Error: the source map is invalid or lists no sources")))
    error = F.array(F.struct(
        F.lit(ERROR_PATH).alias("source_path"), reason.alias("content"), F.lit("error").alias("origin")))

    def in_map(m: Column) -> Column:
        rows = F.transform(entries(m), lambda e: F.struct(
            e["path"].alias("source_path"), e["text"].alias("content"), F.when(e["text"] != "", "embedded").alias("origin")))
        return F.when(m["sources"].isNotNull(), rows).otherwise(error)

    rows = files.select("map_url", F.inline(let(parsed, in_map)))
    target = resolve_url(F.col("source_path"), F.col("map_url"))
    rows = materialize(rows.withColumn("_file", F.when(F.col("origin").isNull(), target)), "listed")
    embedded = rows.where("origin IS NOT NULL").select("map_url", "source_path", "content", "origin")

    # Kept apart from the embedded files, which would all meet on a null key.
    wanted = rows.where("origin IS NULL AND _file IS NOT NULL").select("map_url", "source_path", "_file")
    asked = wanted.select("_file").distinct().repartition(tasks, "_file")
    given = by_url.join(asked, by_url.url == asked._file, "left_semi")
    many = F.ceil(F.count(F.lit(1)) / F.lit(TASK_ROWS // 4)).alias("_parts")
    popular = F.broadcast(wanted.groupBy("_file").agg(many).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    looks = tasks_for(wanted)
    place = F.pmod(F.xxhash64("map_url", "source_path"), parts).cast("int").alias("_part")
    wanted = wanted.join(popular, "_file", "left").select("map_url", "source_path", "_file", place).repartition(looks, "_file", "_part")
    bodies = given.select(F.col("url").alias("_file"), F.col("status").alias("_status"), F.col("body").alias("_body")).join(
        popular, "_file", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("_parts")
    bodies = bodies.repartition(looks, "_file", "_part").hint("merge")
    got = F.col("_status").between(200, 299)
    missing = F.concat(
        F.lit("Skipping missing source file: "), F.col("_file"), F.lit(" (Status: "), F.col("_status").cast("string"),
        F.lit(")"))
    looked_up = wanted.join(bodies, ["_file", "_part"]).select(
        "map_url", "source_path", F.when(got, F.coalesce("_body", F.lit(""))).otherwise(missing).alias("content"),
        F.when(got, "fetched").otherwise("missing").alias("origin"))
    return embedded.unionByName(looked_up)


def source_tree(rebuilt: DataFrame) -> DataFrame:
    """Folders and files of the rebuilt sources, folders first, then by name.

    Paths of a map meet once, in as many tasks as there are nodes for.
    """
    parts = F.split("source_path", "/", -1)

    def nodes(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.struct(
            F.array_join(F.slice(p, F.lit(1), n), "/").alias("path"),
            F.array_join(F.slice(p, F.lit(1), n - F.lit(1)), "/").alias("parent"),
            F.element_at(p, n).alias("name"), n.alias("depth"), (n < F.size(p)).alias("inner")))

    tasks = tasks_for(rebuilt, F.size(parts))
    placed = rebuilt.select("map_url", "source_path").repartition(tasks, "map_url")
    rows = placed.select("map_url", F.inline(let(parts, nodes)))
    tree = rows.groupBy("map_url", "path", "parent", "name", "depth").agg(F.max("inner").alias("is_folder"))
    siblings = W.partitionBy("map_url", "parent", "depth").orderBy(F.col("is_folder").desc(), "name")
    return tree.withColumn("position", F.row_number().over(siblings))
