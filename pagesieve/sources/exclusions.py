"""Long exclusion lists: a table of lines against a table of URLs, not each with each.

A plain line can only stand in a URL that holds all its trigrams, so it is looked
for where its rarest one is. Rarity is counted over the URLs themselves; a line
with a trigram that no URL holds is dropped unread. Lines and URLs are joined on
that one trigram and the lines found so are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.sources.addressed import materialize
from pagesieve.sources.pages import exclusion_test

GRAM = 3
# Lines of one trigram that are verified together, in one row of the index.
LINES_PER_ROW = 256
# Above this a written table is not broadcast.
BROADCAST_BYTES = 32 << 20
# Regexes are part of the plan; a longer list of them is refused.
MAX_REGEX_LINES = 1000


def _grams(text: Column, size: int) -> Column:
    """The different pieces of ``size`` characters of a text, in one walk."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * size + "))"), F.lit(1)))


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    """Mark a written table for broadcast if its rows, with the bytes of ``text``, are few."""
    own = F.lit(64) if text is None else F.lit(64) + F.octet_length(F.col(text).cast("string"))
    size = df.agg(F.sum(own.cast("bigint"))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different plain lines of ``lines`` (line), in lower case, and the regex lines; blank ones are skipped."""
    used = lines.select("line").where(F.col("line").rlike(r"(?U)[^\s\x{FEFF}]"))
    is_regex = F.col("line").startswith("/") & F.col("line").endswith("/")
    return used.where(~is_regex).select(F.lower("line").alias("line")).distinct(), used.where(is_regex).distinct()


def _url_grams(urls: DataFrame, sizes: list[int]) -> DataFrame:
    """(url, low, gram) of ``urls`` (url, low)."""
    return urls.select("url", "low", F.explode(F.concat(*[_grams(F.col("low"), n) for n in sizes])).alias("gram"))


def line_index(plain: DataFrame, urls: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, lines): plain lines under the piece of theirs that the fewest of ``urls`` hold.

    A line shorter than a trigram is such a piece itself. Lines that no URL can hold are left out.
    """
    pieces = F.when(F.length("line") < GRAM, F.array("line")).otherwise(_grams(F.col("line"), GRAM))
    spelled = materialize(plain.select("line", F.explode(pieces).alias("gram")), "spelled")
    wanted = materialize(spelled.select("gram").distinct(), "grams")
    held = _url_grams(urls, sizes).join(_small(wanted), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    held = _small(materialize(held, "held"))
    rarest = spelled.join(held, "gram", "left").groupBy("line").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    keyed = materialize(rarest.where("least.n > 0").select("line", F.col("least.gram").alias("gram")), "keyed")
    parts = keyed.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / LINES_PER_ROW).alias("parts"))
    parts = _small(materialize(parts, "parts"))
    part = F.pmod(F.xxhash64("line"), F.col("parts"))
    return materialize(keyed.join(parts, "gram").groupBy("gram", part.alias("part")).agg(
        F.collect_list("line").alias("lines")).drop("part"), "index")


def excluded_urls(urls: DataFrame, lines: DataFrame) -> DataFrame:
    """(url): the different ``urls`` (url) that a line of ``lines`` (line) hits; as ``pages.exclusion_test``."""
    plain, regexes = split_lines(lines)
    plain = materialize(plain, "plain")
    urls = materialize(urls.select("url").where("url IS NOT NULL").distinct().withColumn("low", F.lower("url")), "urls")
    sizes = sorted(r.n for r in plain.select(F.least(F.length("line"), F.lit(GRAM)).alias("n")).distinct().collect())
    hits = urls.select("url").where(F.lit(False))
    if sizes:
        index = _small(line_index(plain, urls, sizes), "lines")
        verified = F.exists("lines", lambda line: F.contains(F.col("low"), line))
        hits = _url_grams(urls, sizes).join(index, "gram").where(verified).select("url")
    found = [r.line for r in regexes.limit(MAX_REGEX_LINES + 1).collect()]
    if len(found) > MAX_REGEX_LINES:
        raise ValueError(f"more than {MAX_REGEX_LINES} regex lines in an exclusion list")
    test = exclusion_test(F.col("url"), found)
    if test is not None:
        hits = hits.union(urls.where(test).select("url"))
    return hits.distinct()


def exclude_by_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``pages`` without those whose URL a line of the table ``lines`` (line) hits; for lists too long for a predicate.

    Lines mean what they mean in ``pages.exclude_urls``. A page without a URL stays.
    Each different URL is tested once, however many pages have it.
    """
    hits = materialize(excluded_urls(pages, lines), "hits")
    return pages.join(_small(hits, "url"), "url", "left_anti").select(pages.columns)
