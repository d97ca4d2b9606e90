"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads windows of words that overlap by half. A word comes in twice:
as its hashed three-byte pieces with the ends of the word marked, averaged, and
as its own hashed embedding. Two gated recurrent layers of opposite direction
read the window, attention weighs their states, and a logistic unit scores the
pooled state. A text scores as its worst window; every window of it is scored.

Labels are given for texts, not windows: at first the window with the most telling
word stands for a toxic text, then in each turn of the training the worst
window of each text stands for it, and random ones of clean texts are added. The network
is trained in numpy, on the driver, on a bounded sample of labelled texts; tasks
get its weights and score batches of windows. What words contribute is computed
once for each different word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagesieve.llm.common import BLOCK_BYTES, _mix, bounded, free_name, hash_spans, materialize, word_spans

WINDOW, STRIDE = 16, 8
HIDDEN, PIECE_SIZE, WORD_SIZE, BUCKETS = 8, 16, 8, 4096
#: Texts of each label that the network learns from, those of smallest hash, and their longest.
SAMPLE_TEXTS, SAMPLE_BYTES = 1200, 64 << 10
#: Turns over the texts, and the windows of clean texts that a turn sees besides their worst ones.
TURNS, CLEAN_WINDOWS, BATCH, RATE, WORD_DROPOUT, DECAY = 14, 4000, 128, 0.01, 0.3, 0.02
#: Turns in which the window of a toxic text is the one with its most telling word.
LIKELY_TURNS = 4
THRESHOLD = 0.3
_NOT_WORD = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


class Words:
    """The different words of some texts: their buckets, and the words of each text as numbers."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        data = [(t or "").lower().translate(_NOT_WORD).encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join(data), np.uint8)
        starts, ends = word_spans(buffer)
        hashes = hash_spans(buffer, starts, ends)
        offsets = np.cumsum([0, *(len(x) + 1 for x in data)])
        self.bounds = np.searchsorted(starts, offsets)
        known, first, self.tokens = np.unique(hashes, return_index=True, return_inverse=True)
        self.n = len(known)
        self.bucket = (known & np.uint64(BUCKETS - 1)).astype(np.int64)
        # a space on both sides of each word: its pieces are as many as its bytes
        lengths = (ends - starts)[first]
        total = lengths + 2
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        spot = np.repeat(starts[first], total) + at - 1
        inside = (at > 0) & (at <= np.repeat(lengths, total))
        letters = np.where(inside, buffer[np.clip(spot, 0, max(0, len(buffer) - 1))], 32).astype(np.uint64) if self.n else np.zeros(0, np.uint64)
        pieces = _mix((letters[:-2] << np.uint64(16)) + (letters[1:-1] << np.uint64(8)) + letters[2:]) if self.n else letters
        whole = at[:-2] < np.repeat(lengths, total)[:-2]
        self.pieces = (pieces[whole] & np.uint64(BUCKETS - 1)).astype(np.int32)
        self.lengths = lengths

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each window, the text it is of); the token n pads short texts."""
        counts = np.diff(self.bounds)
        n = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = (k * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < counts[text][:, None]
        at = np.where(inside, self.bounds[:-1][text][:, None] + at, 0)
        tokens = self.tokens[at] if len(self.tokens) else np.zeros_like(at)
        return np.where(inside, tokens, self.n).astype(np.int32), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name, and what is computed from them."""

    def __init__(self, seed: int = 11, kind: type = np.float32) -> None:
        rng = np.random.default_rng(seed)
        size = PIECE_SIZE + WORD_SIZE
        self.w = {
            "pieces": rng.normal(0, 0.5, (BUCKETS, PIECE_SIZE)), "words": rng.normal(0, 0.1, (BUCKETS, WORD_SIZE)),
            "into": rng.normal(0, size ** -0.5, (size, 6 * HIDDEN)), "bias": np.zeros(6 * HIDDEN),
            "state": rng.normal(0, HIDDEN ** -0.5, (2, HIDDEN, 3 * HIDDEN)), "look": rng.normal(0, 0.3, 2 * HIDDEN),
            "out": rng.normal(0, 0.3, 2 * HIDDEN), "level": np.zeros(1)}
        self.w = {k: v.astype(kind) for k, v in self.w.items()}

    def word_vectors(self, words: Words, chosen: np.ndarray | None = None) -> np.ndarray:
        """The input vector of each word, or of the chosen ones."""
        which = np.arange(words.n) if chosen is None else chosen
        out = np.empty((len(which), PIECE_SIZE + WORD_SIZE), self.w["out"].dtype)
        for a in range(0, len(which), 20_000):
            own = which[a:a + 20_000]
            flat, first = piece_rows(words, own)
            out[a:a + len(own), :PIECE_SIZE] = np.add.reduceat(self.w["pieces"][words.pieces[flat]], first, axis=0) / words.lengths[own, None]
            out[a:a + len(own), PIECE_SIZE:] = self.w["words"][words.bucket[own]]
        return out

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What each word gives to the gates of both directions; the last row pads: its update gate keeps the state."""
        pad = np.zeros((1, 6 * HIDDEN), vectors.dtype)
        pad[:, [*range(HIDDEN, 2 * HIDDEN), *range(4 * HIDDEN, 5 * HIDDEN)]] = 30
        return np.concatenate([vectors @ self.w["into"] + self.w["bias"], pad])

    def forward(self, inputs: np.ndarray, tokens: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The logit of each window; with ``keep``, what the way back needs is put there."""
        n, h3 = len(tokens), 3 * HIDDEN
        state = np.zeros((2, n, HIDDEN), inputs.dtype)
        states = np.empty((2, WINDOW, n, HIDDEN), inputs.dtype)
        x = np.empty((2, n, h3), inputs.dtype)
        for t in range(WINDOW):
            x[0] = inputs[tokens[:, t], :h3]
            x[1] = inputs[tokens[:, WINDOW - 1 - t], h3:]
            g = state @ self.w["state"]
            gates = sigmoid(x[..., :2 * HIDDEN] + g[..., :2 * HIDDEN])
            reset, update, held = gates[..., :HIDDEN], gates[..., HIDDEN:], g[..., 2 * HIDDEN:]
            new = np.tanh(x[..., 2 * HIDDEN:] + reset * held)
            after = new + update * (state - new)
            if keep is not None:
                keep.append((state, reset, update, held, new))
            state = after
            states[0, t], states[1, WINDOW - 1 - t] = state[0], state[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        real = (tokens != len(inputs) - 1).T
        look = np.where(real, both @ self.w["look"], -1e9)
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        if keep is not None:
            keep.append((both, weight, pooled))
        return pooled @ self.w["out"] + self.w["level"][0]

    def backward(self, inputs: np.ndarray, tokens: np.ndarray, keep: list, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the weights behind the inputs, and of the inputs, for slopes of the logits."""
        both, weight, pooled = keep[-1]
        d = {"out": pooled.T @ slope, "level": np.array([slope.sum()]), "state": np.zeros_like(self.w["state"])}
        d_pooled = slope[:, None] * self.w["out"]
        d_weight = (both * d_pooled).sum(axis=2)
        d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d["look"] = np.einsum("tb,tbh->h", d_look, both)
        d_both = weight[..., None] * d_pooled + d_look[..., None] * self.w["look"]
        d_inputs = np.zeros_like(inputs)
        d_state = np.zeros((2, len(tokens), HIDDEN), inputs.dtype)
        for t in range(WINDOW - 1, -1, -1):
            state, reset, update, held, new = keep[t]
            d_state[0] += d_both[t, :, :HIDDEN]
            d_state[1] += d_both[WINDOW - 1 - t, :, HIDDEN:]
            d_new = d_state * (1 - update) * (1 - new ** 2)
            d_update = d_state * (state - new) * update * (1 - update)
            d_reset = d_new * held * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update, d_new * reset], axis=2)
            d_x = np.concatenate([d_reset, d_update, d_new], axis=2)
            np.add.at(d_inputs[:, :3 * HIDDEN], tokens[:, t], d_x[0])
            np.add.at(d_inputs[:, 3 * HIDDEN:], tokens[:, WINDOW - 1 - t], d_x[1])
            d["state"] += np.einsum("dbh,dbg->dhg", state, d_gates)
            d_state = d_state * update + d_gates @ self.w["state"].transpose(0, 2, 1)
        return d, d_inputs[:-1]

    def slopes(self, words: Words, tokens: np.ndarray, label: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Slopes of the mean logistic loss of some windows."""
        chosen, local = np.unique(tokens, return_inverse=True)
        local = local.reshape(tokens.shape)
        pads = len(chosen) and chosen[-1] == words.n
        chosen = chosen[:-1] if pads else chosen  # the pad stays the last row of the inputs
        vectors = self.word_vectors(words, chosen)
        if rng is not None:
            vectors[:, PIECE_SIZE:] *= rng.random((len(chosen), 1)) >= WORD_DROPOUT
        inputs, keep = self.inputs(vectors), []
        logits = self.forward(inputs, local, keep)
        d, d_inputs = self.backward(inputs, local, keep, (sigmoid(logits) - label) / len(tokens))
        d["into"], d["bias"] = vectors.T @ d_inputs, d_inputs.sum(axis=0)
        d_vectors = d_inputs @ self.w["into"].T
        d["pieces"], d["words"] = np.zeros_like(self.w["pieces"]), np.zeros_like(self.w["words"])
        flat, _ = piece_rows(words, chosen)
        share = d_vectors[:, :PIECE_SIZE] / words.lengths[chosen, None]
        np.add.at(d["pieces"], words.pieces[flat], np.repeat(share, words.lengths[chosen], axis=0))
        d_words = d_vectors[:, PIECE_SIZE:] * (vectors[:, PIECE_SIZE:] != 0)
        np.add.at(d["words"], words.bucket[chosen], d_words)
        return d

    def logits(self, words: Words, tokens: np.ndarray) -> np.ndarray:
        inputs = self.inputs(self.word_vectors(words))
        return np.concatenate([np.zeros(0, inputs.dtype), *(self.forward(inputs, tokens[a:a + 8192]) for a in range(0, len(tokens), 8192))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text, 0 for those without words."""
        words = Words(texts)
        tokens, text = words.windows()
        out = np.zeros(len(texts))
        if len(tokens):
            np.maximum.at(out, text, sigmoid(self.logits(words, tokens).astype(float)))
        return out


def piece_rows(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the chosen words lie, and where each word starts among them."""
    lengths = words.lengths[chosen]
    first = np.cumsum(lengths) - lengths
    return np.repeat(words.first[chosen] - first, lengths) + np.arange(int(lengths.sum())), first


def telling_words(words: Words, labels: np.ndarray) -> np.ndarray:
    """How much more often each word occurs in toxic texts than in clean ones, weighed by how often."""
    text = np.repeat(np.arange(len(labels)), np.diff(words.bounds))
    pairs = np.unique(text * words.n + words.tokens)
    toxic = labels[pairs // words.n] == 1
    in_toxic = np.bincount(pairs[toxic] % words.n, minlength=words.n)
    in_clean = np.bincount(pairs[~toxic] % words.n, minlength=words.n)
    share = (in_toxic + 0.5) / (labels == 1).sum() / ((in_clean + 0.5) / (labels == 0).sum())
    return in_toxic * np.log(np.maximum(share, 1))


def train(texts: list[str], labels: np.ndarray, turns: int = TURNS, seed: int = 11) -> Network:
    """A network for labelled texts; those without words are passed over."""
    network, rng = Network(seed), np.random.default_rng(seed)
    words = Words(texts)
    tokens, text = words.windows()
    if not len(tokens):
        return network
    have, first = np.unique(text, return_index=True)
    label = labels[have].astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in network.w.items()}
    square = {k: np.zeros_like(v) for k, v in network.w.items()}
    step = 0
    of_window = label[np.searchsorted(have, text)]
    clean = np.flatnonzero(of_window == 0)
    telling = telling_words(words, labels)[np.minimum(tokens, words.n - 1)] * (tokens < words.n)
    likely = np.lexsort((-telling.max(axis=1), text))[first]
    for turn in range(turns):
        logits = network.logits(words, tokens)
        worst = np.lexsort((-logits, text))[first]
        if turn < LIKELY_TURNS:  # the network can't tell yet
            worst = np.where(label == 1, likely, worst)
        rows = np.concatenate([worst, rng.choice(clean, max(len(first), CLEAN_WINDOWS))])
        own = of_window[rows]
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            step += 1
            slopes = network.slopes(words, tokens[rows[part]], own[part], rng)
            rate = RATE * (1 - turn / turns) + RATE / 20
            for k, d in slopes.items():
                mean[k] += 0.1 * (d - mean[k])
                square[k] += 0.001 * (d * d - square[k])
                network.w[k] *= 1 - rate * DECAY * (k in ("pieces", "words"))
                network.w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(network.w[k].dtype)
    return network


def held_out(doc_id: Column) -> Column:
    """The quarter of documents of which no label is learnt; a null id is not of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS) -> Network | float:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); the share of toxic ones if only one label occurs."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    wanted = known.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(sample).union(
        known.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(sample))
    rows = (docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
            .join(bounded(materialize(wanted, "wanted")), "doc_id").select("doc_id", "text", "toxic").limit(4 * sample).collect())
    rows.sort(key=lambda r: (r.doc_id, r.text))
    toxic = np.array([r.toxic for r in rows])
    if len(set(toxic.tolist())) < 2:
        return float(toxic.mean()) if len(toxic) else 0.0
    return train([r.text for r in rows], toxic)


def scored(docs: DataFrame, network: Network | float) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``_score``.

    All rows and columns stay, a column ``_score`` too: the new one then takes more
    underscores. Null texts and texts without words score 0 and equal texts equally.
    Where only one label is known, all score its share.
    """
    name = free_name("_score", docs.columns)
    if isinstance(network, float):
        return docs.withColumn(name, F.lit(network))
    shared = docs.sparkSession.sparkContext.broadcast(network.w)

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Network()
        own.w = shared.value
        for part in parts:
            out, block, size = [], [], 0
            for text in part:
                block.append(text)
                size += len(text or "")
                if size > BLOCK_BYTES:
                    out.append(own.score(block))
                    block, size = [], 0
            out.append(own.score(block))
            yield pd.Series(np.concatenate(out))

    return docs.withColumn(name, score("text"))
