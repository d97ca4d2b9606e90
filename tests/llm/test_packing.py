import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import packing
from pagesieve.llm.queries import QUERIES, tokenizer_path


def plain_first_fit(lengths, room):
    bins, out = [], []
    for n in lengths:
        k = next((i for i, left in enumerate(bins) if left >= n), None)
        if k is None:
            bins.append(room)
            k = len(bins) - 1
        bins[k] -= n
        out.append(k)
    return out


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(deadline=None)
def test_first_fit_is_the_plain_one(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())


@given(st.text(alphabet=st.sampled_from(list("ab1.' \n\t\r  \x1c\x85é<|endoftext|>")), max_size=60))
@settings(deadline=None, max_examples=300)
def test_parts_encode_as_the_whole(encoders, text):
    tokenizer, encoder = encoders
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_parts_of_a_text_are_encoded_together(encoders):
    tokenizer, _ = encoders

    class Counting:
        texts = 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder = packing.Encoder(tokenizer_path())
    encoder.tokenizer = Counting()
    words = [f"{w}{i}{end}" for i in range(300) for w in ("ab", "don't", "\nx", "é<|endoftext|>", "'s", "\u00a0c") for end in ("", ".", "\x85")]
    text = " ".join(w for w in words if not w.endswith("\x85"))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # the first part and all others
    assert encoder.tokenizer.texts == 2
    text = " ".join(words)  # parts that end in white space are encoded by themselves
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder._together(["a", "b"]).keys() == {"a", "b"} and encoder._together([]) == encoder._together(["a b"]) == {}



@given(st.lists(st.text(alphabet=st.sampled_from(list("aB1.,!?' \n\t\x1c\x85\u00a0é&<|endoftext|>")), max_size=30), max_size=6))
@settings(deadline=None, max_examples=300)
def test_texts_encode_together_as_alone(encoders, texts):
    tokenizer, encoder = encoders
    data, ends = encoder.encode(pa.array(texts, pa.string()))
    own = [np.frombuffer(data[a:b], "<u4").tolist() for a, b in zip(ends, ends[1:])]
    assert own == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_words_of_many_texts_are_encoded_once(encoders):
    tokenizer, _ = encoders

    class Counting:
        spent = 0

        def encode_batch_fast(self, texts, **options):
            self.spent += sum(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    encoder = packing.Encoder(tokenizer_path())
    encoder.tokenizer = Counting()
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    texts = ["a " + end.join(words) + end + "b" for end in (" ", ". ", ", ", ".\n", "\n", "!\n")]
    data, ends = encoder.encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert np.frombuffer(data[a:b], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # each word after a space, and after a newline, in whatever company
    assert encoder.tokenizer.spent < 2.5 * len(texts[0])


def test_slices_hold_a_bounded_size_of_text(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    texts = ["abc", None, "defgh", "", "x" * 30, "y", "z" * 9, "u"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(texts)], ["_row", "doc_id", "text"])
    found = [part.column(2).to_pylist() for part in packing._slices([batch])]
    assert found == [["abc", None, "defgh", ""], ["x" * 30], ["y", "z" * 9], ["u"]]


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        piece = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece) and len(piece) == 4 * r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert by_doc.keys() == texts.keys()
    for spans in [*by_sequence.values(), *([x[:2] for x in v] for v in by_doc.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
    for spans in by_doc.values():
        assert sum(n for _, n, _ in spans) == spans[0][2]
    assert all(sum(n for _, n in v) <= 2048 for v in by_sequence.values())
    return by_sequence


def test_query_packs_every_id_once(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sequences = check_packed(QUERIES["op6_first_fit_packing"](spark, sf).collect(), texts)
    filled = sum(n for v in sequences.values() for _, n in v)
    assert filled / (2048 * len(sequences)) > 0.97


def test_nulls_repeats_empty_and_long(spark, docs):
    rows = docs([None, "", "a b", "a b", "word " * 9000])
    packed = packing.pack(rows.union(rows), tokenizer_path(), group_pieces=3).collect()
    assert sum(r.length for r in packed if r.doc_id == 0) == 2
    assert sum(r.length for r in packed) == 2 * (1 + 1 + 3 + 3 + next(r.doc_tokens for r in packed if r.doc_id == 4))
    assert packing.pack(rows.limit(0), tokenizer_path()).count() == 0


class Plan:
    """Catches the function that Spark would run over batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, read, schema):
        self.read = read
        return self


def test_an_idle_worker_holds_no_ids_of_parts(spark, monkeypatch):
    given_back = []
    monkeypatch.setattr(packing, "give_back", lambda: given_back.append(1))
    packing.encoder.cache_clear()
    read = packing.pieces(Plan(), tokenizer_path()).read
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([5, 6]), pa.array(["one two three", None])], ["_row", "doc_id", "text"])
    (found,) = read(iter([batch]))
    own = packing.encoder(tokenizer_path())
    assert found.column("doc_id").to_pylist() == [5, 6] and not own.known and not own.spaced and given_back == [1]
    assert own.ids("one two three")


def test_few_texts_are_split_at_a_time():
    texts = pa.array(["x" * 100_000] * 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), texts], ["_row", "doc_id", "text"])
    sizes = [part.num_rows for part in packing._slices(iter([batch]))]
    assert sum(sizes) == 100 and max(sizes) <= 21
