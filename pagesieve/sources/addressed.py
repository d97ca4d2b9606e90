"""Content-addressed sources of a job.

Pages are walked once. What they hold and what was fetched for them is kept in two
kinds of tables: places say where a text stands and name it by its hash, texts hold
each different text once. Scans run over texts, joins move places, and only who
shows texts fetches them, last, by their hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import decode_text
from pagesieve.session import shared_dir
from pagesieve.sources.pages import EXTERNAL_ORD, FULL, MAX_CONTENT_BYTES, PASSIVE, parse_pages, usable_response


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table that several steps read, in folders ``by`` a column, and read it back.

    Without this each reader would scan the texts again; a written table also
    survives the loss of an executor.
    """
    path = f"{shared_dir(df.sparkSession, name)}/table"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def content_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Addressed:
    """``documents``: the pages themselves, with their text, which hardly ever repeats.
    ``places``: (page_id, url, source, kind, source_ord, n_bytes, is_too_large, digest) of all scripts.
    ``texts``: (digest, n_bytes, content) of each different script.
    ``build_data``: (page_id, url, content) of pages that carry some; full mode only.
    """

    documents: DataFrame
    places: DataFrame
    texts: DataFrame
    build_data: DataFrame

    def with_text(self, places: DataFrame) -> DataFrame:
        """``places`` with ``content`` in place of the hash; a null hash has none."""
        return places.join(self.texts.select("digest", "content"), "digest", "left").drop("digest")

    def sources(self) -> DataFrame:
        """All sources with their texts, a copy for each place."""
        return self.documents.unionByName(self.with_text(self.places))


def newest_bodies(fetched: DataFrame) -> DataFrame:
    """(url, digest, n_bytes) of the usable answer that stands for each URL; bodies themselves are not moved."""
    own = fetched.where(F.upper("method") == "GET") if "method" in fetched.columns else fetched
    times = [F.col(c) for c in ("fetched_at", "ts") if c in fetched.columns][:1]
    usable = own.where(usable_response(F.col("status"), F.col("body")))
    place = F.struct(*times, F.col("status"), content_hash(F.col("body")).alias("digest"), F.octet_length("body").cast("bigint").alias("n_bytes"))
    return usable.groupBy("url").agg(F.max(place).alias("_newest")).select("url", "_newest.digest", "_newest.n_bytes")


def address(pages: DataFrame, fetched: DataFrame | None = None, mode: str = PASSIVE, max_bytes: int | None = MAX_CONTENT_BYTES) -> Addressed:
    """Sources of ``pages`` and of what was ``fetched`` for them.

    As for single sources, the passive scan lists texts above ``max_bytes`` as too
    large, the full scan forgets them and empty ones and decodes the rest; None lifts the gate.
    """
    size = F.octet_length("content").cast("bigint")
    large = F.lit(False) if max_bytes is None else F.coalesce(F.col("n_bytes") > max_bytes, F.lit(False))
    parsed = parse_pages(pages, mode).withColumn("n_bytes", size)
    script = F.col("kind") == "inline"
    if mode == FULL:
        is_source = F.col("kind").isin("html", "inline")
        parsed = parsed.where(~is_source | ((F.coalesce("n_bytes", F.lit(0)) > 0) & ~large))
        parsed = parsed.withColumn("content", F.when(F.col("kind") == "html", decode_text(F.col("content"))).otherwise(F.col("content")))
    items = materialize(parsed.withColumn("digest", F.when(script, content_hash(F.col("content")))), "items", "kind")

    named = ["page_id", "url", "source", "kind", "source_ord", "n_bytes", large.alias("is_too_large")]
    documents = items.where("kind = 'html'").select(*named, "content")
    places = items.where(script).select(*named, "digest")
    texts = items.where(script).select("digest", "n_bytes", "content")
    if fetched is not None:
        refs = items.where("kind = 'ref'").select("page_id", "url", "source_ord", F.col("content").alias("source"))
        answers = newest_bodies(fetched).withColumnRenamed("url", "source")
        external = refs.join(answers, "source").select(
            "page_id", "url", "source", F.lit("external").alias("kind"), (F.col("source_ord") + EXTERNAL_ORD).alias("source_ord"),
            "n_bytes", large.alias("is_too_large"), "digest")
        if mode == FULL:
            external = external.where(~F.col("is_too_large"))
        external = materialize(external, "external")
        places = places.unionByName(external)
        bodies = fetched.where(F.coalesce("body", F.lit("")) != "").select(
            content_hash(F.col("body")).alias("digest"), F.octet_length("body").cast("bigint").alias("n_bytes"), F.col("body").alias("content"))
        texts = texts.unionByName(bodies.join(external.select("digest").distinct(), "digest", "left_semi"))
    once = texts.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value("n_bytes").alias("n_bytes"), F.any_value("content").alias("content"))
    if mode == FULL:
        once = once.withColumn("content", decode_text(F.col("content")))
    return Addressed(documents, places, materialize(once, "texts"), items.where("kind = 'next'").select("page_id", "url", "content"))
