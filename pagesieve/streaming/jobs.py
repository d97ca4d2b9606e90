"""Structured Streaming forms of the scan and of the store."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesieve.operators.extract import addressed_findings, sanitize_findings, secret_findings
from pagesieve.operators.store import DEBOUNCE_MS, PASSIVE_MAX_AGE_MS, passive_key, read_results, skip_scanned, upsert_results
from pagesieve.rules import strict_rules
from pagesieve.schemas import PAGES
from pagesieve.sources.addressed import address, materialize
from pagesieve.sources.pages import MAX_CONTENT_BYTES, extract_sources, scannable, size_gate
from pagesieve.sources.sinks import safe_findings
from pagesieve.streaming.kept import KeptStore

LATENESS = "10 minutes"
LONGEST_SCAN = "1 hour"


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Pages of the files in ``folder`` that ``glob`` names, and of the files in folders it names: a table may be either."""
    # a single file is only read as what a glob found, which braces make of any name
    return (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder.rstrip('/')}/{{{glob}}}"))


def scan_stream(
    pages: DataFrame, exclusions: Sequence[str] = (), excluded_rule_ids: Sequence[str] = (),
    max_bytes: int | None = MAX_CONTENT_BYTES,
) -> DataFrame:
    """Findings of arriving pages.  No state is kept, so it runs in append mode."""
    sources = size_gate(extract_sources(scannable(pages, exclusions)), max_bytes)
    return secret_findings(sources, strict_rules(excluded_rule_ids))


def debounce_stream(
    events: DataFrame, key: str = "tab_id", gap_ms: int = DEBOUNCE_MS, lateness: str = LATENESS,
) -> DataFrame:
    """The last event of each burst: a session closes after ``gap_ms`` of silence.

    A burst comes out once the watermark has passed it; a stream that ends needs
    a closing event (``closing_event``) to let the last ones out.

    A session window also takes in an event exactly one gap later, which the
    debounce does not, so windows are a microsecond shorter than the gap.
    """
    rest = [c for c in events.columns if c != key]
    gap = f"{gap_ms * 1000 - 1} microseconds"
    bursts = events.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap)).agg(
        F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_last"))
    return bursts.select(key, "_last.*")


def closing_event(events: DataFrame, gap_ms: int = DEBOUNCE_MS, lateness: str = LATENESS) -> DataFrame:
    """An event without a key, late enough to close every burst of a table of events that ends."""
    after = F.max("ts") + F.expr(f"INTERVAL {lateness}") + F.make_interval(secs=F.lit(gap_ms / 1000 + 1))
    rest = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c != "ts"]
    return events.agg(after.alias("ts")).where("ts IS NOT NULL").select("ts", *rest).select(events.columns)


def first_scans(pages: DataFrame, keys: Sequence[str] = ("tab_id", "url"), lateness: str = LATENESS) -> DataFrame:
    """Each (tab, url) once; what the stream may forget, the store still knows."""
    return pages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def _within(longest: str) -> Column:
    """Scans with both times that took at most ``longest``."""
    return F.coalesce(F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"), F.lit(False))


def drop_cancelled_stream(
    results: DataFrame, closed: DataFrame, longest: str = LONGEST_SCAN, lateness: str = LATENESS,
) -> DataFrame:
    """Results of tabs that were not closed while their scan ran, from a stream of results and one of closings.

    An outer join of both streams: a result waits until the watermark has passed
    its end and comes out if no closing of its tab lies between its start and that.
    A closing is kept for as long as a result may still arrive that it cancels,
    so the state holds what happened within ``longest`` and the lateness, no more.
    Results that took longer or lack a time are not judged here but are in ``judged_apart``.
    The batch form knows one closing of each tab, its last; here each one counts.
    """
    scans = results.where(_within(longest)).withWatermark("finished_at", lateness)
    ends = closed.select(F.col("tab_id").alias("_tab"), F.col("closed_at").alias("_closed")).withWatermark("_closed", lateness)
    during = (
        (F.col("tab_id") == F.col("_tab")) & (F.col("_closed") >= F.col("started_at")) & (F.col("_closed") <= F.col("finished_at"))
        & (F.col("_closed") >= F.col("finished_at") - F.expr(f"INTERVAL {longest}")))
    return scans.join(ends, during, "left").where("_closed IS NULL").select(results.columns)


def judged_apart(results: DataFrame, longest: str = LONGEST_SCAN) -> DataFrame:
    """The results that ``drop_cancelled_stream`` leaves to ``store.drop_cancelled``: overlong ones and those without a time."""
    return results.where(~_within(longest))


def with_ends(results: DataFrame, closed: DataFrame, lateness: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """Tables of results and closings that end, each with a last row that lets all others out of the stream.

    The last rows lie beyond each other and beyond the lateness, so they cancel nothing and stay in the state.
    """
    last = results.select(F.col("finished_at").alias("at")).union(closed.select("closed_at")).agg(F.max("at").alias("at"))
    last = last.where("at IS NOT NULL").withColumn("at", F.col("at") + F.expr(f"INTERVAL {lateness}"))

    def row(df: DataFrame, seconds: int, **values: Column) -> DataFrame:
        at = F.col("at") + F.make_interval(secs=F.lit(seconds))
        times = ("started_at", "finished_at", "closed_at")
        return df.unionByName(last.select(*[
            (at if c in times else values.get(c, F.lit(None))).cast(t).alias(c) for c, t in df.dtypes]))

    return row(results, 1), row(closed, 2, tab_id=F.lit(0))


def result_rows(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Store rows of scanned pages, without findings or with."""
    counts = findings.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_findings"))
    done = pages.select("page_id", "url").join(counts, "page_id", "left")
    return done.select(
        passive_key(F.col("url")).alias("key"), "url", F.lit("complete").alias("status"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.unix_millis(F.current_timestamp()).alias("timestamp_ms"), F.lit(None).cast("string").alias("error"))


def run_scan(pages: DataFrame, findings_path: str, results_path: str, checkpoint: str,
             excluded_rule_ids: Sequence[str] = (), once: bool = True, exclusions: Sequence[str] = (),
             fetched: DataFrame | None = None, max_bytes: int | None = MAX_CONTENT_BYTES) -> StreamingQuery:
    """Scan a stream of pages, and the scripts ``fetched`` for them, into a findings table and a log of results.

    A batch is a passive scan of its pages: each page is walked once and each
    different script of the batch scanned once, whole up to ``max_bytes``.
    Each batch overwrites its own ``run`` and ``batch_id`` folder, so a batch that
    runs again after a failure replaces what it wrote and adds nothing twice.  The
    run is named by the checkpoint: batches of another checkpoint stay.  Findings
    are sanitised and hold a hash in place of the secret.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = scannable(batch, exclusions)
        target = f"run={run}/batch_id={batch_id}"
        held = address(wanted, fetched, max_bytes=max_bytes)
        found = safe_findings(sanitize_findings(addressed_findings(held, strict_rules(excluded_rule_ids))))
        found.write.mode("overwrite").parquet(f"{findings_path}/{target}")
        # The findings just written are read back instead of scanned for again.
        stored = batch.sparkSession.read.schema(found.schema).parquet(f"{findings_path}/{target}")
        result_rows(stored, wanted).write.mode("overwrite").parquet(f"{results_path}/{target}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_kept_scan(pages: DataFrame, findings_path: str, store_path: str, checkpoint: str,
                  excluded_rule_ids: Sequence[str] = (), once: bool = True, exclusions: Sequence[str] = (),
                  fetched: DataFrame | None = None, max_bytes: int | None = MAX_CONTENT_BYTES,
                  max_age_ms: int = PASSIVE_MAX_AGE_MS, force: bool = False) -> StreamingQuery:
    """Scan a stream of pages into a findings table and the kept store of results.

    Pages with a complete result that is not older than ``max_age_ms`` are not
    scanned again, unless ``force`` is set; each batch reads and rewrites only the
    buckets of its pages. A batch writes its findings first and the store last, and
    one the store already holds is passed over, so a batch that runs again changes
    nothing, wherever it broke off.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = KeptStore(spark, store_path)
        manifest = store.manifest()
        if manifest.batches.get(run, -1) >= batch_id:
            return
        wanted = scannable(batch, exclusions)
        keys = wanted.select(passive_key(F.col("url")).alias("key"))
        known = store.current(manifest, store.touched(keys, manifest))
        fresh = read_results(known, F.unix_millis(F.current_timestamp()), max_age_ms)
        todo = materialize(skip_scanned(wanted, fresh, force), "todo")
        held = address(todo, fetched, max_bytes=max_bytes)
        found = safe_findings(sanitize_findings(addressed_findings(held, strict_rules(excluded_rule_ids))))
        target = f"{findings_path}/run={run}/batch_id={batch_id}"
        found.write.mode("overwrite").parquet(target)
        store.upsert(result_rows(spark.read.schema(found.schema).parquet(target), todo), run, batch_id)

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_results(spark: SparkSession, results_path: str) -> DataFrame:
    """Newest result of each URL in the log."""
    log = spark.read.parquet(results_path).drop("run", "batch_id")
    return upsert_results(log, log.where(F.lit(False)))
