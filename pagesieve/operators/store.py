"""Results store: scan once, upsert, expire, and the batch form of debouncing.

The store is an append-only log of result rows; the current row of a URL is
the newest one.  Ages are in milliseconds since the epoch, as stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagesieve.functions.urls import is_scannable

# Key prefixes of our own, then fixed values: ages and sizes of stored results.
PASSIVE_PREFIX, FULL_PREFIX = "passive_scan", "scan_cache_"
PASSIVE_MAX_AGE_MS, FULL_MAX_AGE_MS = 12 * 60 * 60 * 1000, 2 * 60 * 60 * 1000
PURGE_ALL = -1
RECENT_PAGES = 100
RESULT_BUDGET_BYTES = 30 * 1024 * 1024
DEBOUNCE_MS = 100
QUOTA_EXCEEDED = "QUOTA_EXCEEDED"

_BUCKET_MS = 60 * 1000


def cache_key(prefix: str, url: Column) -> Column:
    """Key of a full result."""
    return F.concat(F.lit(prefix), url)


def passive_key(url: Column) -> Column:
    return F.concat(F.lit(PASSIVE_PREFIX + "|"), url)


def session_key(tab_id: Column, url: Column) -> Column:
    return F.concat(tab_id.cast("string"), F.lit("|"), url)


def millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("bigint")


def debounce(events: DataFrame, key: str = "tab_id", gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Events that no other event of their key follows within ``gap_ms``.

    A key is cut into minutes, or longer spells if the gap is longer, so that a
    busy one is not sorted in a single task.  Events just after a spell begins
    are shown to the spell before as well, where they only serve as followers.
    """
    spell_us = max(_BUCKET_MS, gap_ms) * 1000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spell = F.floor(micros / F.lit(spell_us)).cast("bigint")
    early = micros - spell * F.lit(spell_us) < F.lit(gap_ms * 1000)
    shown_in = F.when(early, F.array(spell, spell - F.lit(1))).otherwise(F.array(spell))
    placed = events.withColumn("_us", micros).withColumn("_spell", spell).select(
        "*", F.explode(shown_in).alias("_bucket"))
    later = W.partitionBy(key, "_bucket").orderBy("_us", "event_id")
    follower = F.lead("_us").over(later)
    fires = follower.isNull() | (follower - F.col("_us") >= F.lit(gap_ms * 1000))
    return placed.withColumn("_fires", fires).where(
        F.col("_fires") & (F.col("_bucket") == F.col("_spell"))).select(*events.columns)


def skip_scanned(pages: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Pages that still need a scan: each once, and not those with a complete result."""
    todo = pages.where(is_scannable(F.col("url")))
    keys = ["tab_id", "url"] if "tab_id" in pages.columns else ["url"]
    if force:
        return todo
    done = store.where(F.col("status") == "complete").select("url")
    return todo.dropDuplicates(keys).join(done, "url", "left_anti").select(*pages.columns)


def newest_results(rows: DataFrame) -> DataFrame:
    """The newest row per key, failed ones too."""
    rest = [c for c in rows.columns if c != "key"]
    # Later states win where two rows carry one time, then more findings; a row
    # without a time is older than any other.
    rank = F.when(F.col("status") == "scanning", 0).otherwise(1)
    place = F.struct(F.coalesce("timestamp_ms", F.lit(-1)), rank, "n_findings", "status")
    newest = rows.groupBy("key").agg(F.max_by(F.struct(*rest), place).alias("_row"))
    return newest.select("key", "_row.*").select(*rows.columns)


def upsert_results(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Current rows after ``batch``: the newest per key, failed ones removed."""
    return newest_results(store.unionByName(batch)).where(F.col("status") != "failed")


def expire_results(store: DataFrame, now_ms: int | Column, max_age_ms: int, prefix: str = PASSIVE_PREFIX) -> DataFrame:
    """Clean up: drop rows of ``prefix`` that are older than ``max_age_ms``.

    ``PURGE_ALL`` drops every row of the prefix.  A row without a time stays.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    ours = F.col("key").startswith(prefix)
    if max_age_ms == PURGE_ALL:
        return store.where(~ours)
    stale = F.coalesce(now - F.col("timestamp_ms") > F.lit(max_age_ms), F.lit(False))
    return store.where(~(ours & stale))


def read_results(store: DataFrame, now_ms: int | Column, max_age_ms: int) -> DataFrame:
    """Rows a reader may use: with a time, and not older than ``max_age_ms``."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    stamp = F.col("timestamp_ms")
    return store.where(stamp.isNotNull() & (stamp != 0) & (now - stamp <= F.lit(max_age_ms)))


def migrate_store(store: DataFrame, now_ms: int | Column) -> DataFrame:
    """Drop rows under the old ``tab|url`` keys and stamp those without a time."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    ours = F.col("key").startswith(PASSIVE_PREFIX)
    unstamped = F.coalesce(F.col("timestamp_ms"), F.lit(0)) == 0
    return store.where(~F.col("key").rlike(r"^[0-9]+\|")).withColumn(
        "timestamp_ms", F.when(ours & unstamped, now.cast("bigint")).otherwise(F.col("timestamp_ms")))


def recent_pages(access_log: DataFrame, n: int = RECENT_PAGES, key: str = "url") -> DataFrame:
    """The ``n`` pages used last, newest first: a top-k, not a full sort."""
    last = access_log.groupBy(key).agg(F.max("ts").alias("last_used"))
    return last.orderBy(F.col("last_used").desc(), F.col(key)).limit(n)


def drop_cancelled(results: DataFrame, closed: DataFrame) -> DataFrame:
    """Drop results of tabs that were closed while their scan ran."""
    last = closed.groupBy("tab_id").agg(F.max("closed_at").alias("_closed"))
    joined = results.join(last, "tab_id", "left")
    cancelled = F.coalesce(
        (F.col("_closed") >= F.col("started_at")) & (F.col("_closed") <= F.col("finished_at")), F.lit(False))
    return joined.where(~cancelled).select(*results.columns)


def evict_tab(session: DataFrame, closed: DataFrame) -> DataFrame:
    """Drop session rows, keyed ``tab|url``, of closed tabs."""
    tabs = closed.select(F.col("tab_id").cast("string").alias("_tab")).distinct()
    rows = session.withColumn("_tab", F.substring_index("key", "|", 1))
    return rows.join(tabs, "_tab", "left_anti").select(*session.columns)


def _json_bytes(*fields: Column) -> Column:
    """Bytes of the JSON object of ``fields`` without its braces."""
    return F.octet_length(F.to_json(F.struct(*fields))) - F.lit(2)


def apply_budget(sources: DataFrame, found: DataFrame, max_bytes: int = RESULT_BUDGET_BYTES) -> DataFrame:
    """Drop the texts of pages whose serialised result is over the budget.

    The size is that of the texts and findings as JSON, summed per page before
    anything is joined; findings are never dropped.
    """
    text_bytes = sources.groupBy("page_id").agg(F.sum(F.octet_length(F.to_json(F.create_map(
        F.coalesce("source", F.lit("")), F.col("content")))).cast("bigint") - F.lit(1)).alias("n"))
    finding_bytes = found.groupBy("page_id").agg(F.sum((_json_bytes(*[
        F.col(c) for c in found.columns if c != "page_id"]) + F.lit(3)).cast("bigint")).alias("n"))
    over = text_bytes.unionByName(finding_bytes).groupBy("page_id").agg(F.sum("n").alias("_bytes")).where(
        F.col("_bytes") > max_bytes).select("page_id", F.lit(QUOTA_EXCEEDED).alias("error"))
    flagged = sources.join(over, "page_id", "left")
    return flagged.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
