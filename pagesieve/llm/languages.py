"""Language identification by cross-parsing entropy.

A suffix automaton of some labelled text of each language knows all its substrings.
A text is parsed against each: from its start on the longest match is taken as a
phrase, then the next from there, so few phrases mean that the text is made of long
pieces of that language. A phrase points into n characters and so costs log2(n)
bits; the language with the fewest bits for each character wins.

Automata are made from a bounded sample on the driver and sent to the tasks as
tables of transitions in which a missing one leads to what follows the root and
counts a phrase. Tasks step through many pieces of texts and all languages at a
time, so each character costs a few array operations; whole texts are parsed.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows of each language to learn from, those of smallest hash, and the characters of each that are taken.
SAMPLE_ROWS, EXCERPT = 512, 512
#: Characters to learn from of all languages together; each has an equal share and one excerpt at least.
LEARNED_CHARS = 1 << 17
UNKNOWN = "und"

#: Codes of characters: the end of a piece, what is no letter, 48 frequent letters, 12 that rarer ones share, any other letter.
END, GAP, OWN, SHARED, OTHER, CODES = 0, 1, 2, 50, 62, 64
#: Letters and gaps that are parsed in one go; a longer text makes one more phrase for each such piece.
PIECE = 512
#: Characters that are parsed at a time; bounds the scratch memory of a task.
BLOCK_CHARS = 1 << 21


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is such a row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Excerpts of labelled texts for each language, in hash order.

    At most ``SAMPLE_ROWS`` rows of ``EXCERPT`` characters come to the driver for each
    language. Rows are counted first, and of a language with many only a share by
    hash is ranked; one that has too few in its share, as where a few rows are
    repeated over and over, is ranked whole.
    """
    labelled = docs.where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    key = F.xxhash64("text", "doc_id")
    start = F.pmod(key, F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int") + 1
    cut = labelled.select("lang", key.alias("key"), F.substring("text", start, F.lit(EXCERPT)).alias("excerpt"))

    def first(rows: DataFrame) -> dict[str, list[str]]:
        place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "excerpt"))
        out: dict[str, list[str]] = {}
        for row in sorted(rows.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).collect(), key=lambda r: (r.lang, r.place)):
            out.setdefault(row.lang, []).append(row.excerpt)
        return out

    parts = [(name, float(min(1, 4 * SAMPLE_ROWS / n))) for name, n in counts.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, share double"))
    out = first(cut.join(shares, "lang").where((F.col("key") / float(1 << 64) + 0.5) < F.col("share")).drop("share"))
    few = [name for name, n in counts.items() if len(out.get(name, ())) < min(n, SAMPLE_ROWS)]
    if few:
        out |= first(cut.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in few], "lang string")), "lang", "left_semi"))
    return dict(sorted(out.items()))


def alphabet(texts: Iterable[str]) -> dict[int, int]:
    """The code of each letter that occurs in some texts, in lower case."""
    counts = Counter(c for text in texts for c in text.lower() if c.isalpha())
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    n = SHARED - OWN
    return {ord(c): OWN + k if k < n else SHARED + ord(c) % (OTHER - SHARED) for k, c in enumerate(ranked)}


def code_table(codes: dict[int, int]) -> np.ndarray:
    """The code of each code point; capitals have that of their small letter."""
    table = np.full(0x110000, GAP, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            small = c.lower()
            table[point] = codes.get(ord(small) if len(small) == 1 else point, OTHER)
    return table


def coded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): the codes of all texts, runs of gaps as one, and where each text begins and ends in them."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[points]
    keep = np.empty(len(codes), bool)
    keep[0] = True
    np.logical_or(codes[1:] != GAP, codes[:-1] != GAP, out=keep[1:])
    places = np.cumsum(keep)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return codes[keep], np.concatenate([[0], places])[offsets]


def automaton(codes: Iterable[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a sequence; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for code in codes:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and code not in following[at]:
            following[at][code] = new
            at = link[at]
        if at != -1:
            target = following[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and following[at].get(code) == target:
                    following[at][code] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return following


@dataclass
class Model:
    """Languages, the code of each known letter, bits of a phrase, and transitions (state, code, target) of each automaton.

    ``key`` tells models apart, so that a Python worker makes its tables once.
    """

    key: str
    names: list[str]
    codes: dict[int, int]
    bits: np.ndarray
    moves: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out and have a text and a lang."""
    texts = sample(docs)
    codes = alphabet(t for own in texts.values() for t in own)
    table = code_table(codes)
    names, bits, moves = [], [], []
    share = max(EXCERPT, LEARNED_CHARS // max(1, len(texts)))
    for name, own in texts.items():
        values, bounds = coded(own, table)
        taken = values[:min(len(values), max(bounds[1], share))].tolist()
        if not any(c != GAP for c in taken):
            continue
        # the end code between excerpts keeps matches within one
        ends = set(bounds[1:-1].tolist())
        states = automaton(c for k, v in enumerate(taken) for c in ((END, v) if k in ends else (v,)))
        flat = [(s, c, t) for s, row in enumerate(states) for c, t in row.items() if c != END]
        state, code, target = np.array(flat, np.int32).T
        names.append(name)
        bits.append(math.log2(len(taken) + 1))
        moves.append((state, code.astype(np.uint8), target, len(states)))
    return Model(os.urandom(8).hex(), names, codes, np.array(bits), moves)


class Parser:
    """Counts the phrases of texts for all languages of a model at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.table = code_table(model.codes)
        sizes = [n for *_, n in model.moves]
        roots = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if roots[-1] * CODES * 4 >= 1 << 31:
            raise ValueError("too much text to learn from")
        self.roots = (roots[:-1] * CODES).astype(np.int32)
        # an entry is four times the place of the next state's row, plus the phrases that end
        self.next = np.empty((int(roots[-1]), CODES), np.int32)
        for (state, code, target, n), root in zip(model.moves, roots):
            first = np.full(CODES, root, np.int64)
            at_root = state == 0
            first[code[at_root]] = target[at_root] + root
            # a character that the language lacks is a phrase of its own
            alone = (first == root).astype(np.int64)
            alone[END] = 0
            rows = self.next[root:root + n]
            rows[0] = first * CODES * 4 + alone
            rows[1:] = first * CODES * 4 + alone + 1
            rows[state, code] = (target + root) * CODES * 4
        self.next = self.next.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, codes of each text, letters of each text)."""
        codes, bounds = coded(texts, self.table)
        sizes = np.diff(bounds)
        letters = np.diff(np.concatenate([[0], np.cumsum(codes != GAP)])[bounds])
        n = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = bounds[:-1][owner] + k * PIECE
        length = np.minimum(PIECE, sizes[owner] - k * PIECE)
        # an end code behind each piece; longest pieces first, so that those still open are the first ones
        codes = np.insert(codes, start + length, END)
        start = start + np.arange(len(start))
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        width = len(self.roots)
        state = np.tile(self.roots, (len(start), 1))
        found = np.zeros((len(start), width), np.int32)
        still = np.searchsorted(-length, -np.arange(PIECE + 1), side="right")
        for t in range(int(length[0]) + 1 if len(length) else 0):
            m = still[t]
            moved = self.next.take(state[:m] + codes[start[:m] + t][:, None])
            found[:m] += moved & 3
            np.right_shift(moved, 2, out=state[:m])
        total = np.stack([np.bincount(owner, found[:, j], len(texts)) for j in range(width)], 1)
        return total, sizes, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for a in range(0, len(text or ""), BLOCK_CHARS):
                parts.append(text[a:a + BLOCK_CHARS])
                owner.append(i)
        width = len(self.roots)
        phrases, letters = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
        sizes = np.zeros(len(texts), np.int64)
        a = 0
        while a < len(parts) and width:
            b, held = a, 0
            while b < len(parts) and (b == a or held + len(parts[b]) <= BLOCK_CHARS):
                held += len(parts[b])
                b += 1
            own = np.array(owner[a:b])
            some, n, m = self.phrases(parts[a:b])
            np.add.at(phrases, own, some)
            np.add.at(sizes, own, n)
            np.add.at(letters, own, m)
            a = b
        names, scores = [], []
        bits = phrases * self.model.bits / np.maximum(sizes, 1)[:, None]
        for row, n in zip(bits, letters):
            if not n:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(row, kind="stable")
            best, next_best = row[order[0]], row[order[1]] if width > 1 else np.inf
            names.append(self.model.names[order[0]])
            scores.append(1.0 if np.isinf(next_best) else float(next_best / (best + next_best)))
        return names, scores


_PARSERS: dict[str, Parser] = {}


def parser_of(model: Model) -> Parser:
    """The parser of a model; a worker keeps the last one from task to task."""
    if model.key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model.key] = Parser(model)
    return _PARSERS[model.key]


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Letters count in lower case; anything else between them is one gap. The score
    is the share of the second best language in the bits of the best two: one half
    for a tie, which goes to the name that comes first, and 1 if there is one language only.
    A null text, one without a letter, and any where nothing was learned, is ``und``
    with score 0. Repeated rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for batch in batches:
            names, scores = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, lang_pred string, score double")
