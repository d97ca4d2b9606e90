"""Personal data: four fixed kinds, and more identifiers by bootstrapping from their contexts.

E-mail addresses, IPv4 addresses, card and phone numbers are the seeds. The one
to three words or marks before an identifier-like value, and the one after it,
are its lexical patterns (``call me at``, ``contact :``), if a word is among
them. Patterns and the values found in them make a graph. Spark scores it in
turns: a pattern by the share of its values that are trusted, a value by the
patterns it occurs in. Patterns of high confidence and enough different trusted
values then mark the unseen values in their places.

Identifier-like is every seed, every unbroken value of at least five characters
with a digit or an at sign, and every run of seven to nineteen digits in groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import bounded, materialize

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that patterns find.
FOUND = "other"
TURNS = 3
CONFIDENCE = 0.8
SUPPORT = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits: had one from its start failed, so would that one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What no unbroken value holds.
_UNBROKEN = re.compile(r"""[^\s"'()<>,;|\[\]{}]+""")
#: A cue that is glued to its value (``id=AB-77123``); not the groups of an address in hexadecimal.
_GLUED = re.compile(r"[^\W\d_]{2,}(?:[=#]|:(?![0-9A-Fa-f]{1,4}:))|[:=#*]+")
#: Digits in groups, as in cards and phones.
_GROUPS = re.compile(r"""(?<![^\s"'()<>,;|\[\]{}:=#])[+(]{0,2}[0-9]++(?:[\x20().-]{1,2}+[0-9]++)+""")
_LAST_GROUP = re.compile(r"[\x20().-]+[0-9]+\Z")
_NEXT = re.compile(r"\s*(\w+|[^\w\s])")
BEFORE = 3
#: Longer patterns are named by their hash.
_LONG = 120

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs so that long runs cost no square."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds in order; each kind leftmost and without overlap."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, FOUND)[kind]}:{start}:{end}" for start, kind, end in spans)


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is of a fixed kind) of the identifier-like values, in order."""
    seeds = sorted({(s, e) for s, _, e in base})
    found = set()
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            value, after = m.group(), text[m.end():m.end() + 1]
            if after == "@" or after == "_" or after.isalnum():
                value = _LAST_GROUP.sub("", value)
            if " " in value and 7 <= sum(c.isdigit() for c in value) <= 19:
                found.add((m.start(), m.start() + len(value)))
    if found or "@" in text or any(c.isdigit() for c in text):
        for m in _UNBROKEN.finditer(text):
            value = m.group()
            if len(value) < 5 or not _identifying(value):
                continue
            start, end = m.span()
            while end > start and text[end - 1] in ".!?:":
                end -= 1
            last = next((k for k in range(end - 1, start - 1, -1) if text[k] == "@" or text[k].isdigit()), start)
            while (cue := _GLUED.match(text, start, end)) and end - cue.end() >= 5 and cue.end() <= last:
                start = cue.end()
            if end - start >= 5 and text[start] != "/":
                found.add((start, end))
    out, k, reach = [(s, e, True) for s, e in seeds], 0, -1
    for start, end in sorted(found):
        while k < len(seeds) and seeds[k][0] < end:
            reach = max(reach, seeds[k][1])
            k += 1
        if reach <= start:
            out.append((start, end, False))
    return sorted(out)


def _identifying(value: str) -> bool:
    return "@" in value or any(c.isdigit() for c in value)


def _words_before(text: str, end: int) -> list[str]:
    """Up to three words or marks right before a place, the nearest first."""
    out: list[str] = []
    while len(out) < BEFORE:
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        start -= start == end
        if start < 0:
            break
        out.append(text[start:end].lower())
        end = start
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns in which a span stands; its place in them is ``_``."""
    before, after = _words_before(text, start), _NEXT.match(text, end)
    out = [[*reversed(before[:n]), "_"] for n in range(1, len(before) + 1)]
    if after:
        out.append(["_", after.group(1).lower()])
    named = [" ".join(words) for words in out if any(c.isalpha() for word in words for c in word)]
    return [x if len(x) <= _LONG else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in named]


def placed_values(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[list[str], str, int, int, bool]]:
    """(patterns, value, start, end, whether of a fixed kind) of every identifier-like value that has a context."""
    for start, end, seed in instances(text, base):
        patterns = contexts(text, start, end)
        if patterns:
            yield patterns, text[start:end], start, end, seed


_SCAN = ("row long, doc_id long, base array<struct<start: int, kind: int, end: int>>, base_sha256 string, "
         "placed array<struct<patterns: array<string>, value: string, start: int, end: int, seed: boolean>>")
_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_PLACED_TYPE = pa.list_(pa.struct([
    ("patterns", pa.list_(pa.string())), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_())]))


def scan(docs: DataFrame) -> DataFrame:
    """Fixed kinds and identifier-like values of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, sha, placed = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                sha.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                placed.append([dict(zip(("patterns", "value", "start", "end", "seed"), x)) for x in placed_values(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, _BASE_TYPE), pa.array(sha, pa.string()), pa.array(placed, _PLACED_TYPE)],
                ["row", "doc_id", "base", "base_sha256", "placed"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(read, _SCAN)


def trusted_patterns(placed: DataFrame, turns: int = TURNS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, score, trusted) of high-confidence patterns over occurrences (pattern, value, seed)."""
    edges = materialize(placed.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    scored = edges.withColumn("trust", F.col("seed").cast("double"))
    for turn in range(turns):
        patterns = scored.groupBy("pattern").agg(
            F.avg("trust").alias("score"), F.count_if(F.col("trust") >= confidence).alias("trusted"))
        patterns = patterns.where((F.col("score") > 0) & (F.col("trusted") >= support))
        if turn == turns - 1:
            break
        # a value is as good as the best sure pattern that it occurs in, so that doubtful ones don't lift themselves; seeds stay sure
        patterns = bounded(materialize(patterns.where(F.col("score") >= confidence), "patterns"))
        best = edges.where("NOT seed").join(patterns, "pattern").groupBy("value").agg(F.max("score").alias("reached"))
        scored = materialize(
            edges.join(best, "value", "left")
            .withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0)))).drop("reached"),
            "scored")
    return patterns.where(F.col("score") >= confidence)


def private_spans(
    docs: DataFrame, turns: int = TURNS, confidence: float = CONFIDENCE, support: int = SUPPORT,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored).

    Returns (doc_id, base_sha256, base, spans): spans are (start, kind, end) in code
    points, ``base`` those of the fixed kinds. Null texts count as empty and have no
    spans; repeated rows give repeated results; a null doc_id stays null. Without
    contexts that seeds share there are no patterns, and only the fixed kinds are
    reported. A value in groups and a group of it may both be reported. An empty
    table gives no rows.
    """
    scanned = materialize(scan(docs), "scan")
    placed = scanned.select("row", F.explode("placed").alias("p")).select("row", "p.*").withColumn("pattern", F.explode("patterns"))
    trusted = materialize(trusted_patterns(placed, turns, confidence, support).select("pattern"), "trusted")
    found = (placed.where("NOT seed").join(bounded(trusted), "pattern", "left_semi")
             .select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("span"))
             .groupBy("row").agg(F.collect_set("span").alias("found")))
    both = scanned.drop("placed").join(found, "row", "left")
    return both.select(
        "doc_id", "base_sha256", "base",
        F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(_SPANS)))).alias("spans"))


_SPANS = "array<struct<start: int, kind: int, end: int>>"


def spans_text(column: str):
    kinds = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(F.transform(
        column, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
