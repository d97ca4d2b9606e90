"""A kept store of results: a versioned table in hash buckets, which a stream can change safely.

Rows lie in buckets by the hash of their key. A change rewrites the buckets it
touches, each into the bucket's next slot, and then writes a manifest that names
the slot of every bucket. Readers take the newest manifest, so a change is seen
whole or not at all, and one that broke off is written over by the next. Slots and
manifests are used in turn: what is older than ``SLOTS`` changes of a bucket is
overwritten, so neither the table nor a read grows with the number of changes.

A batch of a stream is named by its run and number and noted in the manifest with
the rows it brought; a batch that comes again changes nothing. The store has one
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagesieve.operators.store import expire_results, newest_results

SLOTS = 3
BUCKETS = 64
RESULTS = "key string, url string, status string, n_findings bigint, timestamp_ms bigint, error string"
_MANIFEST = "version bigint, buckets int, bucket int, slot int, run string, batch_id bigint"


@dataclass(frozen=True)
class Manifest:
    """A version: the slot of each bucket that holds rows, and the last batch of each run."""

    version: int
    buckets: int
    slots: dict[int, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        head = (self.version, self.buckets)
        return [(*head, None, None, None, None), *((*head, b, s, None, None) for b, s in self.slots.items()),
                *((*head, None, None, r, n) for r, n in self.batches.items())]


class KeptStore:
    """The table at ``path``; ``buckets`` counts when it is made, an existing one keeps its own number."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType = RESULTS, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def manifest(self) -> Manifest:
        """The newest version; version 0 of a store that isn't there yet."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        version = max((r.version for r in rows), default=0)
        rows = [r for r in rows if r.version == version]
        return Manifest(
            version, rows[0].buckets if rows else self.buckets, {r.bucket: r.slot for r in rows if r.bucket is not None},
            {r.run: r.batch_id for r in rows if r.run is not None})

    def bucket(self, key: Column, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest.buckets)).cast("int")

    def stored(self, manifest: Manifest | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version, removed ones too; with ``only``, nothing but these buckets is read."""
        manifest = manifest or self.manifest()
        wanted = manifest.slots if only is None else manifest.slots.keys() & set(only)
        paths = [f"{self.path}/data/bucket={b}/slot={manifest.slots[b]}" for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col("key").isNotNull())

    def current(self, manifest: Manifest | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The current results: those that failed are gone."""
        return self.stored(manifest, only).where(F.coalesce(F.col("status") != "failed", F.lit(True)))

    def touched(self, rows: DataFrame, manifest: Manifest, key: str = "key") -> list[int]:
        """The buckets of ``rows``; as many numbers as there are buckets at most."""
        return [r[0] for r in rows.select(self.bucket(F.col(key), manifest)).distinct().collect()]

    def _commit(self, manifest: Manifest, rows: DataFrame, touched: list[int], batches: dict[str, int]) -> Manifest:
        slots = {**manifest.slots, **{b: (manifest.slots.get(b, -1) + 1) % SLOTS for b in touched}}
        new = replace(manifest, version=manifest.version + 1, slots=slots, batches={**manifest.batches, **batches})
        if touched:
            names = rows.columns
            # a row without a key in each bucket replaces the files of a bucket that has become empty, too
            marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
            marked = rows.withColumn("bucket", self.bucket(F.col("key"), manifest)).unionByName(marks, allowMissingColumns=True)
            of = F.broadcast(self.spark.createDataFrame([(b, slots[b]) for b in touched], "bucket int, slot int"))
            (marked.join(of, "bucket").repartition("bucket").select(*names, "bucket", "slot")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{self.path}/data"))
        (self.spark.createDataFrame(new.rows(), _MANIFEST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/at={new.version % SLOTS}"))
        return new

    def upsert(self, batch: DataFrame, run: str | None = None, batch_id: int = 0) -> bool:
        """The newest row of each key stays; failed ones stay as marks of removal. False if the batch was there already.

        Rows may come in any order and in any batches: the result is that of all at
        once. Rows without a key are passed over.
        """
        manifest = self.manifest()
        if run is not None and manifest.batches.get(run, -1) >= batch_id:
            return False
        batch = batch.where(F.col("key").isNotNull())
        touched = self.touched(batch, manifest)
        self._commit(manifest, newest_results(self.stored(manifest, touched).unionByName(batch)), touched,
                     {} if run is None else {run: batch_id})
        return True

    def change(self, how: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets in which ``how``, which keeps or drops rows, drops any."""
        manifest = self.manifest()
        before = self.stored(manifest)
        count = F.count(F.lit(1))
        of = self.bucket(F.col("key"), manifest).alias("bucket")
        kept = how(before).groupBy(of).agg(count.alias("kept"))
        less = before.groupBy(of).agg(count.alias("n")).join(kept, "bucket", "left").where("kept IS NULL OR kept < n")
        touched = [r.bucket for r in less.select("bucket").collect()]
        if touched:
            self._commit(manifest, how(self.stored(manifest, touched)), touched, {})

    def expire(self, now_ms: int, max_age_ms: int, **options: str) -> None:
        """Drop results, and marks of removal, that are too old."""
        self.change(lambda rows: expire_results(rows, now_ms, max_age_ms, **options))
