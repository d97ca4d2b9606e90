"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns estimates how often
each labeller is right, without any given labels. The posterior of each pattern
is a soft label, and a linear scorer over hashed features (word shapes, pairs of
shapes, repetition) learns from the labels of a bounded sample of documents. The
scorer decides, so it also judges documents on which labellers disagree or abstain.

Votes are counted over all documents; there are at most 3 ** labellers patterns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from pagesieve.llm.common import _mix, BLOCK_BYTES, free_name, give_back, hash_spans, word_spans

#: Documents the scorer learns from, those of smallest hash of doc_id and text among texts of at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 10_000, 32 << 10
FEATURES = 1 << 12
GOOD, BAD, NONE = 1, 0, 2
THRESHOLD = 0.5
#: A labeller calls at most this share of good documents bad; its bounds are set so wide.
FALSE_ALARMS = 0.005

_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_MARKS = b" \t\n\x0b\x0c\r.,;:!?'\"-()0123456789"
_PLAIN = _LETTER + _MARKS
_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
# class of each byte in a word shape: upper, lower or beyond ASCII, digit, common mark, other
_CLASS = np.full(256, ord("s"), np.uint8)
for _bytes, _class in ((range(128, 256), "l"), (range(97, 123), "l"), (range(65, 91), "U"), (range(48, 58), "d"), (b".,;:!?'\"-()", "p"), (b" \t\n\x0b\x0c\r", " ")):
    _CLASS[list(_bytes)] = ord(_class)


def _between(value: float, bad: float, good: float) -> int:
    """Bad above one bound, good below another, no vote between."""
    return BAD if value > bad else GOOD if value < good else NONE


def symbols(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    return _between(len(data.translate(None, _PLAIN)) / max(1, len(data)), 0.03, 0.005)


def shouting(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    return _between(len(data.translate(None, _NOT_UPPER)) / max(1, len(data)), 0.2, 0.08)


def one_word(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    """The most frequent word's share."""
    if len(words) < 20:
        return NONE
    return _between(Counter(words).most_common(1)[0][1] / len(words), 0.3, 0.15)


def few_words(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    """Pairs of words that occur again."""
    if len(words) < 20:
        return NONE
    return _between(1 - len(set(zip(words, words[1:]))) / (len(words) - 1), 0.4, 0.2)


def stutter(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    """Words that repeat the one before."""
    if len(words) < 5:
        return NONE
    return _between(sum(map(bytes.__eq__, words, words[1:])) / len(words), 0.1, 0.03)


def odd_words(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    """Words without a letter at either end but for common marks."""
    if len(words) < 5:
        return NONE
    odd = sum(not word.strip(b".,;:!?'\"-()")[-1:].isalnum() and word[-1] < 128 for word in words)
    return _between(odd / len(words), 0.2, 0.05)


def sentences(data: bytes, words: list[bytes], lines: list[bytes]) -> int:
    """Lines that end as sentences do."""
    full = [line for line in lines if line.strip()]
    if not full:
        return NONE
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"', b")") for line in full) / len(full)
    return BAD if ended < 0.2 else GOOD if ended > 0.8 else NONE


LABELLERS = (symbols, shouting, one_word, few_words, stutter, odd_words, sentences)


def votes(text: str | None) -> int:
    """All votes as a number with a digit to base 3 for each labeller; a text without words gets bad ones only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, code = data.split(), 0
    lines = data.split(b"\n")
    for labeller in LABELLERS:
        code = 3 * code + (labeller(data, words, lines) if words else BAD)
    return code


def expectation_maximisation(counts: dict[int, int], labellers: int = len(LABELLERS), turns: int = 100) -> dict[int, float]:
    """The posterior of being good for each pattern of votes, from how often the patterns occur.

    The model: given its class, a document's votes are independent, and abstaining
    says nothing. Good votes are common in both classes, as each labeller knows one kind of junk only; bad votes
    are rare among good documents, which also settles which class is which.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], float)
    digits = np.stack([codes // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)], axis=1)
    voted = digits != NONE
    prior, alarms = 0.8, np.array([[0.3], [FALSE_ALARMS]]).repeat(labellers, axis=1)  # chance of a bad vote by class
    good = n
    for _ in range(turns):
        says = [np.where(digits == BAD, np.log(alarms[c]), np.log(1 - alarms[c])) * voted for c in (BAD, GOOD)]
        odds = (says[GOOD] - says[BAD]).sum(axis=1) + np.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for c, weight in ((BAD, n * (1 - good)), (GOOD, n * good)):
            alarms[c] = (weight @ (digits == BAD) + 0.01) / (weight @ voted + 0.1)
        # kinds of junk differ more than junk and prose: without this bound one of them alone would be the bad class
        alarms[GOOD] = np.minimum(alarms[GOOD], FALSE_ALARMS)
        prior = min(max((n * good).sum() / n.sum(), 1e-3), 1 - 1e-3)
    return dict(zip(codes.tolist(), good.tolist()))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


_SAME, _AGAIN = 0, 1


def features(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashed features, rows they belong to, rows) of blocks of texts, one feature per word, pair or repetition."""
    block: list[bytes] = []

    def flush() -> tuple[np.ndarray, np.ndarray, int]:
        buffer = np.frombuffer(b"\n".join(block), np.uint8)
        starts, ends = word_spans(buffer)
        words = hash_spans(buffer, starts, ends)
        kinds = _CLASS[buffer]
        keep = np.ones(len(kinds), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=keep[1:])
        runs = kinds[keep]
        shapes = hash_spans(runs, *word_spans(runs))
        offsets = np.cumsum([0, *(len(x) + 1 for x in block)])
        rows = np.searchsorted(offsets, starts, "right") - 1
        inside = rows[1:] == rows[:-1]
        pairs = _mix(words[:-1] * np.uint64(3) + words[1:])[inside]
        pair_rows = rows[1:][inside]
        keyed = _mix(pairs + pair_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        again = np.zeros(len(pairs), bool)  # all but one of equal pairs of a row
        again[1:] = keyed[order][1:] == keyed[order][:-1]
        same = words[1:][inside] == words[:-1][inside]
        found = [_bucket(shapes), _bucket(_mix(shapes[:-1] * np.uint64(5) + shapes[1:])[inside]),
                 np.full(int(same.sum()), _SAME), np.full(int(again.sum()), _AGAIN)]
        where = [rows, pair_rows, pair_rows[same], pair_rows[order][again]]
        return np.concatenate(found), np.concatenate(where), len(block)

    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > BLOCK_BYTES:
            yield flush()
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield flush()


def scores(texts: Iterable[str | None], weights: np.ndarray) -> np.ndarray:
    """The probability of being good of each text; 0 for texts without words."""
    out = []
    for found, rows, n in features(texts):
        total = np.bincount(rows, minlength=n)
        raw = np.bincount(rows, weights=weights[found], minlength=n) / np.maximum(total, 1) + weights[-1]
        out.append(np.where(total > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str], soft: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-6) -> np.ndarray:
    """Weights of the features and, last, the bias: logistic regression on soft labels by Adam."""
    index, share, rows, first = [], [], [], 0
    for found, where, n in features(texts):
        cells, count = np.unique(where * FEATURES + found, return_counts=True)
        own, total = cells // FEATURES, np.bincount(where, minlength=n)
        index.append(cells % FEATURES)
        rows.append(own + first)
        share.append(count / total[own])
        first += n
    weights = np.zeros(FEATURES + 1)
    if not first:
        return weights
    index, share, rows = np.concatenate(index), np.concatenate(share), np.concatenate(rows)
    mean = square = np.zeros(FEATURES + 1)
    for step in range(1, steps + 1):
        raw = np.bincount(rows, weights=weights[index] * share, minlength=first) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - soft) / first
        slope = np.append(np.bincount(index, weights=error[rows] * share, minlength=FEATURES), error.sum()) + decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        weights = weights - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return weights


class QualityModel:
    """What was learnt: posteriors of vote patterns, and the scorer."""

    def __init__(self, posterior: dict[int, float], weights: np.ndarray) -> None:
        self.posterior, self.weights = posterior, weights

    def score(self, text: Column) -> Column:
        weights = self.weights

        @F.pandas_udf(DoubleType())
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            try:
                for part in parts:
                    yield pd.Series(scores(part, weights))
            finally:
                give_back()

        return score(text)


@F.pandas_udf(IntegerType())
def vote_code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for part in parts:
            yield part.map(votes).astype("int32")
    finally:
        give_back()


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> QualityModel:
    """Learn from all rows of ``docs`` (doc_id, text), the scorer from a sample of them.

    The votes of every text count. The sample is ``sample`` texts of at most
    ``SAMPLE_BYTES`` bytes, so what comes to the driver is bounded by bytes.
    A table with no rows, or on which all labellers abstain, gives a scorer that
    accepts what has words.
    """
    counted = docs.select(vote_code("text").alias("code")).groupBy("code").count().collect()
    posterior = expectation_maximisation({r.code: r["count"] for r in counted})
    key = F.xxhash64("doc_id", "text")
    # by the hash alone first, so that texts are only moved for the sample
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    keys = short.select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    rows = short.where(key <= F.lit(keys)).limit(sample).select("text").collect() if keys is not None else []
    texts = [r.text for r in rows if r.text and r.text.split()]
    soft = np.array([posterior.get(votes(t), 0.5) for t in texts])
    return QualityModel(posterior, train(texts, soft))


def judge(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``_score``, the chance of good quality.

    All rows and columns stay, a column ``_score`` too: the new one then takes more
    underscores. A null or empty text, or one of white space, scores 0. Equal texts
    score equally.
    """
    model = model or fit(docs)
    return docs.withColumn(free_name("_score", docs.columns), model.score(F.col("text")))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    return docs.where(fit(docs).score(F.col("text")) >= threshold)
