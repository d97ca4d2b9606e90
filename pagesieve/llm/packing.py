"""Packing of documents into training sequences of a fixed length.

Documents become token ids, are cut at multiples of the sequence length, and
the pieces go into sequences by first-fit decreasing. A tournament tree over the
room left in the open sequences finds the first that fits in logarithmic time.
Groups of documents are drawn at random, have a bounded size and are packed
independently, so the work spreads over tasks and no task sees more than a group.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import give_back, materialize

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Pieces a group holds on average; more make less padding and longer tasks.
GROUP_PIECES = 4096
#: Parts of texts whose ids a worker remembers during a task, about 170 MB.
CACHE_WORDS = 800_000
#: How a byte-level vocabulary spells a space.
_SPACE = "\u0120"
_DOUBLE_SPACE = f"^ |[{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}] "
#: Marks that close a word or sentence.
_MARKS = ".,;:!?"
#: Bytes of texts that are split and put together at a time.
SLICE_BYTES = 2 << 20
_PIECES = "_row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def text_parts(text: str) -> list[str]:
    """A text in parts that a byte-level BPE with the usual split encodes independently.

    Such a tokenizer never joins a space to what stands before it unless that is
    white space too, so a text may be cut before a space that follows anything else.
    """
    parts = text.split(" ")
    out = parts[:1]
    for part in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


def pretoken_runs(part: str) -> list[str]:
    """A part without spaces, cut where the usual split does: around single newlines, and after a letter before closing marks."""
    lines = part.split("\n")
    if len(lines) > 1 and not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
        return [part]
    out: list[str] = []
    for line in lines:
        word = line.rstrip(_MARKS)
        out += [word, line[len(word):], "\n"] if word != line and word[-1:].isascii() and word[-1:].isalpha() else [line, "\n"]
    return out[:-1]


class Encoder:
    """Token ids of whole texts as little-endian bytes, with the ids of parts remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by the part without the space it starts with

    def _learn(self, parts: list[str], known: dict[str, bytes], space: str) -> dict[str, bytes]:
        missing = list(set(parts).difference(known))
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = list(set(parts))
        broken: dict[str, list[str]] = {}
        if space and missing:
            broken = {part: cut for part in missing if not part.isalpha() and len(cut := pretoken_runs(part)) > 1}
            first = {cut[0] for cut in broken.values()}.difference(known)
            missing = list(first.union(part for part in missing if part not in broken))
            known.update(self._together([part for part in missing if part and not part[-1].isspace()]))
            missing = [part for part in missing if part not in known]
        found = self.tokenizer.encode_batch_fast([space + part for part in missing], add_special_tokens=False) if missing else []
        for part, own in zip(missing, found):
            known[part] = np.array(own.ids, "<u4").tobytes()
        if broken:
            rest = self._learn([run for cut in broken.values() for run in cut[1:]], self.known, "")
            for part, cut in broken.items():
                known[part] = known[cut[0]] + b"".join(map(rest.__getitem__, cut[1:]))
        return known

    def _together(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that hold no space, each after one: as one text, cut at the tokens that begin with a space.

        Nothing if the text is not cut into as many pieces as there are parts.
        """
        (own,) = self.tokenizer.encode_batch_fast(["".join(" " + part for part in parts)], add_special_tokens=False)
        ids = np.array(own.ids, "<u4")
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(parts) or not len(cuts) or cuts[0]:
            return {}
        data, ends = ids.tobytes(), (4 * np.append(cuts, len(ids))).tolist()
        return {part: data[start:end] for part, start, end in zip(parts, ends, ends[1:])}

    def forget(self) -> None:
        """Drops the ids of parts, so that an idle worker holds the tokenizer only."""
        self.known, self.spaced = {}, {}

    def ids(self, text: str) -> bytes:
        data, _ = self.encode(pa.array([text]))
        return data

    def encode(self, texts: pa.StringArray) -> tuple[bytes, np.ndarray]:
        """The ids of texts one after the other, and where those of each begin and the last end, in bytes.

        Texts are split into parts, and a distinct part is looked up once.
        """
        odd = pc.match_substring_regex(texts, _DOUBLE_SPACE).to_numpy(zero_copy_only=False)
        if odd.any():
            own = [self._spaced_oddly(text.as_py()) if is_odd else self.ids(text.as_py()) for text, is_odd in zip(texts, odd)]
            return b"".join(own), np.cumsum([0, *map(len, own)])
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten()
        first = np.zeros(len(words), bool)
        first[bounds[:-1] - bounds[0]] = True
        rest = words.filter(pa.array(~first)).dictionary_encode()
        heads, others = (x.to_numpy(zero_copy_only=False).tolist() for x in (words.filter(pa.array(first)), rest.dictionary))
        known = list(map(self._learn(others, self.spaced, " ").__getitem__, others))
        known += map(self._learn(heads, self.known, "").__getitem__, heads)
        at = np.empty(len(words), np.int64)
        at[~first] = rest.indices.to_numpy()
        at[first] = len(others) + np.arange(len(heads))
        found = pa.array(known, pa.large_binary()).take(pa.array(at))
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[bounds - bounds[0]]
        return data.to_pybytes()[:ends[-1]] if data else b"", ends

    def _spaced_oddly(self, text: str) -> bytes:
        parts = text_parts(text)
        return b"".join(map(self._learn(parts, self.known, "").__getitem__, parts))


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a worker, kept from task to task; it runs on the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each length, which must be in falling order; bins are numbered as they open."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    most = [room] * (2 * leaves)  # most[i]: the largest room below node i
    bins = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if most[node] < length:
                node += 1
        bins.append(node - leaves)
        most[node] -= length
        while node > 1:
            node //= 2
            largest = max(most[2 * node], most[2 * node + 1])
            if most[node] == largest:
                break
            most[node] = largest
    return bins


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` (_row, doc_id, text), so many at a time that their texts have about a bounded size."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def pieces(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        try:
            yield from cut_by(own.encode, batches)
        finally:
            own.forget()
            give_back()

    def cut_by(encode: Callable[[pa.StringArray], tuple[bytes, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in _slices(batches):
            out: list[tuple] = []
            data, ends = encode(pc.fill_null(batch.column(2), ""))
            rows, doc_ids = (column.to_pylist() for column in batch.columns[:2])
            for row, doc_id, first, last in zip(rows, doc_ids, ends.tolist(), ends[1:].tolist()):
                ids = data[first:last] + end
                n = len(ids) // 4
                for start in range(0, n, tokens):
                    piece = ids[4 * start:4 * (start + tokens)]
                    out.append((row, doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["_row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; more columns are ignored).

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per
    piece. Every row is a document of its own, so repeated rows are packed as often
    as they occur. A null text counts as empty and is the end token alone; a null
    doc_id stays null. Ties in length go by row. An empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer, tokens), "pieces")
    groups = -(-max(1, cut.count()) // group_pieces)

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.sort_by([("length", "descending"), ("_row", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_numpy()
        bins = np.array(first_fit_decreasing(lengths.tolist(), tokens), np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        opens = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = before - np.repeat(before[opens], np.diff(np.append(opens, len(bins))))
        ids = (key[0].as_py() << 32) + bins
        kept = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        yield from (kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
                    .combine_chunks().to_batches())

    return (cut.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .groupBy("_group").applyInArrow(place, (
                "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")))
