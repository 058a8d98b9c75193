"""LM scoring: a causal self-attention model in numpy over subword ids, beside a word-count baseline.

Subwords are a public byte BPE vocabulary cut off at ``ranks`` (lower ranks of a
BPE are a BPE), so that the model is small. The model adds the output of one
self-attention layer, which knows places by how far apart they are, to bigram
log-probabilities. The bigram counts come from all documents that may be learned
from. The attention starts from ``sample_documents`` of them, those of least id
hash, and is then trained on every subword of all of them, in shards whose
weights are averaged. The distribution over subwords is the product of two
choices, one for each digit of a subword's number, of about the square root of the
vocabulary each; the bigram counts set the logits of each choice exactly.

Every window holds CONTEXT subwords. For scores it gives its last half, and
windows follow each other by half a window: each subword is scored once, with at
least half a window before it; windows of a group of texts that hold the same
subwords run through the model once. For training windows lie side by side and each
place is a target. Windows of all texts of a batch run together, with keys before
the text's start and after the query masked.

The baseline gives each token (words, then one end) (c+1) / (N + V + 1) with
counts over all documents learned from. Frequent words (a bounded number) are
looked up in the task; the rest are joined with the table of counts.

Null text counts as empty: one token, the end. Long texts are whole: their windows
are like those of many short ones, and one text must fit a task. Null doc_id counts as empty text
for the fold. Repeated rows are scored one by one. Documents whose id hashes tie are
sampled by text; words whose counts tie are looked up in the task together or not at all. With nothing to learn from, N
and V are 0 and the model is uniform. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, byte_list, lower_ascii, materialise, ragged, release, word_spans

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTEXT = 32
HALF = CONTEXT // 2
WIDTH = 16
#: Windows that run through the model at once.
WINDOWS = 4096
#: Words of which every task holds counts.
MOST_HEAD = 1 << 17
#: Documents that train one copy of the weights, about, and windows of one of its steps.
SHARD_DOCUMENTS = 2000
TRAIN_WINDOWS = 256
#: Documents whose word counts share a bucket, some tens of megabytes, and how many buckets there are at least.
BUCKET_DOCUMENTS, LEAST_BUCKETS = 20_000, 64
_SUM = "n long, sums binary"
_WORD = Rolling(41)
#: The end token's hash in the table of counts.
END_HASH = 1
_TEXTS_BYTES = 4 << 20


@dataclass(frozen=True)
class Subwords:
    """A subword's number has two digits, of the sizes ``shape``: its class and its place in the class. Number 0 is the end of text."""

    ranks: dict[bytes, int]
    number: np.ndarray
    shape: tuple[int, int]

    @property
    def size(self) -> int:
        return int(np.prod(self.shape))

    def digits(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each digit: the number of the digit before, 0 for the first, and the digit."""
        group, place = np.divmod(numbers, self.shape[1])
        return [(np.zeros_like(numbers), group), (group, place)]


@dataclass
class LanguageModel:
    subwords: Subwords
    #: Bigram logits of each digit: a row for each digit before it, and in that for each subword before.
    biases: list[np.ndarray]
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def load_subwords(path: str = RANKS_FILE, ranks: int = 1024) -> Subwords:
    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines) if int(b) < ranks}
    n = len(table) + 1
    side = int(np.ceil(np.sqrt(n)))
    return Subwords(table, np.arange(1, n), (side, -(-n // side)))


def stream_type(s: Subwords) -> np.dtype:
    """Integers that hold a subword's number, as texts of subwords are written."""
    return np.dtype("<u2" if s.size <= 1 << 16 else "<u4")


_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _encoder(s: Subwords) -> tiktoken.Encoding:
    if len(s.ranks) not in _ENCODERS:
        _ENCODERS[len(s.ranks)] = tiktoken.Encoding("subwords", pat_str=r"\n|[^\n]+", mergeable_ranks=s.ranks, special_tokens={})
    return _ENCODERS[len(s.ranks)]


class Tokens:
    """Words of some texts by distinct word: hashes, subwords of each distinct word, and the words in order."""

    def __init__(self, texts: list[bytes], subwords: Subwords | None = None):
        low = [lower_ascii(t) for t in texts]
        data, starts, ends, self.first = word_spans(low)
        # A table of hashes, and not a sort as in numpy's unique().
        coded = pa.array(_WORD.words(data, starts, ends)).dictionary_encode()
        self.hashes, self.word = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        at = np.empty(len(self.hashes), dtype=np.int64)
        at[self.word[::-1]] = np.arange(len(self.word) - 1, -1, -1)
        if subwords is not None:
            joined = data.tobytes()
            words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            ids = np.array(_encoder(subwords).encode_ordinary((b"\n ".join([b"", *words]) + b"\n").decode("utf-8", "replace")), dtype=np.int64)
            cuts = np.flatnonzero(ids == subwords.ranks[b"\n"])
            self.sub_first, self.sub_count = cuts[:-1] + 1, np.diff(cuts) - 1
            self.subs = subwords.number[ids]

    def streams(self) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of all texts, each text after a 0 and before a 0; and where each text's first 0 is (one more at the end)."""
        counts = self.sub_count[self.word]
        sub = self.subs[ragged(self.sub_first[self.word], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[self.first]
        size = np.diff(ends)
        at = np.concatenate(([0], np.cumsum(size + 2)))
        out = np.zeros(at[-1], dtype=np.int64)
        out[np.arange(len(sub)) + np.repeat(at[:-1] + 1 - ends[:-1], size)] = sub
        return out, at


def _groups(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


# ---- the model


def _windows(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context positions (negative: before or past the text) and scored positions (negative: past the text) of every window, and the text of each."""
    inputs = np.diff(at) - 1
    n = -(-inputs // HALF)
    text = np.repeat(np.arange(len(inputs)), n)
    begin = ragged(np.zeros(len(n), dtype=np.int64), n) * HALF
    context = begin[:, None] + np.arange(-HALF, HALF)
    context = np.where((context >= 0) & (context < inputs[text][:, None]), context + at[text][:, None], -1)
    return context, np.where(context[:, HALF:] >= 0, context[:, HALF:] + 1, -1), text


def _whole_windows(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_windows`` for training: windows side by side, each place of them a target."""
    inputs = np.diff(at) - 1
    n = -(-inputs // CONTEXT)
    text = np.repeat(np.arange(len(inputs)), n)
    context = ragged(np.zeros(len(n), dtype=np.int64), n)[:, None] * CONTEXT + np.arange(CONTEXT)
    context = np.where(context < inputs[text][:, None], context + at[text][:, None], -1)
    return context, np.where(context >= 0, context + 1, -1)


#: By query and key of a window: how far the key is behind, and minus infinity where it is ahead.
_BEHIND = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
_CAUSAL = np.where(_BEHIND >= 0, 0, -np.inf).astype(np.float32)
#: Windows and targets that one numpy call works on: what it reads and writes stays in a processor's cache.
_AT_ONCE, _ROWS = 32, 512
#: Ends of the output weights, so that no exponential of a float32 overflows.
_MOST_WEIGHT = 4.0
_DIGITS = ("digit0", "digit1")


def _sums(x: np.ndarray) -> np.ndarray:
    """Row sums; as a product with ones, which is faster than a reduction of short rows."""
    return x @ np.ones(x.shape[-1], dtype=x.dtype)


def _tables(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Query and direct input, key and value of each subword: positions enter by ``near`` only, so both are looked up."""
    e = w["embed"]
    return e @ np.concatenate((w["q"] * e.dtype.type(WIDTH**-0.5), w["x"]), axis=1), e @ np.concatenate((w["k"], w["v"]), axis=1)


def _forward(m: LanguageModel, ids: np.ndarray, real: np.ndarray, asked: int, keep: bool = True) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
    """ids and real (windows, CONTEXT): hidden states of the last ``asked`` places, and with ``keep`` by part of the windows what the gradients need; without, all parts use the same memory."""
    w = m.weights
    kind = w["embed"].dtype
    queries, keys = _tables(w)
    largest = np.sqrt(_sums(queries[:, :WIDTH] ** 2).max() * _sums(keys[:, :WIDTH] ** 2).max()) + w["near"].max()
    h = np.empty((len(ids) * asked, WIDTH), dtype=kind)
    near = (w["near"][np.maximum(_BEHIND, 0)] + _CAUSAL)[-asked:]
    parts = []
    shapes = (asked, 2 * WIDTH), (CONTEXT, 2 * WIDTH), (asked, CONTEXT), (asked, WIDTH)
    room = [np.empty((0, *x), dtype=kind) for x in shapes]
    for start in range(0, len(ids), _AT_ONCE):
        own = ids[start : start + _AT_ONCE]
        if keep or len(room[0]) != len(own):
            room = [np.empty((len(own), *x), dtype=kind) for x in shapes]
        qx, kv, e, o = room
        # Indexes are in range; "clip" lets take() write in place.
        queries.take(own[:, -asked:], axis=0, out=qx, mode="clip")
        keys.take(own, axis=0, out=kv, mode="clip")
        q, k, v = qx[..., :WIDTH], kv[..., :WIDTH], kv[..., WIDTH:]
        np.matmul(q, k.transpose(0, 2, 1), out=e)
        e += near
        # No logit is over ``largest``.
        if largest > 60:
            np.minimum(e, 60, out=e)
        np.exp(e, out=e)
        # Later keys are masked already, and with them places past a text's end: what is left is the half before its start.
        e[~real[start : start + _AT_ONCE, 0], :, :HALF] = 0
        size = _sums(e.reshape(-1, CONTEXT))
        size += 1e-30
        np.matmul(e, v, out=o)
        o = o.reshape(-1, WIDTH)
        o /= size[:, None]
        z = h[start * asked : start * asked + len(o)]
        np.matmul(o, w["o"], out=z)
        z += qx[..., WIDTH:].reshape(-1, WIDTH)
        np.tanh(z, out=z)
        if keep:
            parts.append({"q": q, "k": k, "v": v, "e": e, "size": size, "o": o})
    return h, parts


def _targets(m: LanguageModel, ids: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the targets that count, in order of subword: rows, subword before, subword."""
    flat = targets.reshape(-1)
    rows = np.flatnonzero(flat >= 0)
    rows = rows[np.argsort(flat[rows].astype(np.uint16) if m.subwords.size < 1 << 16 else flat[rows], kind="stable")]
    return rows, ids[:, -targets.shape[1] :].reshape(-1)[rows], flat[rows]


def _choices(m: LanguageModel, h: np.ndarray | None, previous: np.ndarray, target: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, tuple[str, int]]]:
    """The two choices of each target, in parts of a few hundred rows that stay in a processor's cache: rows, logits (overwritten by the next part), where the right ones lie in these as one row, and which weights."""
    s = m.subwords
    kind = m.biases[0].dtype if h is None else h.dtype
    for level, (group, place) in enumerate(s.digits(target)):
        width = s.shape[level]
        bias, at = m.biases[level].reshape(-1, width), previous + group * s.size
        logits, own_bias, starts = np.empty((_ROWS, width), dtype=kind), np.empty((_ROWS, width), dtype=m.biases[level].dtype), np.arange(0, _ROWS * width, width)
        edges = np.searchsorted(target, np.arange(s.shape[0] + 1) * s.shape[1]).tolist() if level else [0, len(target)]
        for g, (first, last) in enumerate(zip(edges[:-1], edges[1:])):
            for a in range(first, last, _ROWS):
                b = min(a + _ROWS, last)
                z = logits[: b - a]
                if h is None:
                    bias.take(at[a:b], axis=0, out=z, mode="clip")
                else:
                    np.matmul(h[a:b], m.weights[f"digit{level}"][g], out=z)
                    z += bias.take(at[a:b], axis=0, out=own_bias[: b - a], mode="clip")
                yield slice(a, b), z, starts[: b - a] + place[a:b], (f"digit{level}", g)


def log_probs(m: LanguageModel, ids: np.ndarray, real: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of ``targets`` (windows, places; negative: none) after as many of the last of ``ids``."""
    rows, previous, target = _targets(m, ids, targets)
    h = _forward(m, ids, real, targets.shape[1], keep=False)[0].take(rows, axis=0) if m.weights else None
    right_ones, sums = (np.empty((2, len(rows)), dtype=m.biases[0].dtype if h is None else h.dtype) for _ in range(2))
    for own, z, right, name in _choices(m, h, previous, target):
        level = _DIGITS.index(name[0])
        z.reshape(-1).take(right, out=right_ones[level, own], mode="clip")
        np.exp(z, out=z)
        sums[level, own] = _sums(z)
    out = np.zeros(targets.size)
    out[rows] = right_ones.sum(axis=0, dtype=np.float64) - np.log(sums, dtype=np.float64).sum(axis=0)
    return out.reshape(targets.shape)


def score_streams(m: LanguageModel, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text of ``Tokens.streams``. Windows of the same subwords have the same score and run through the model once."""
    context, scored, text = _windows(stream, at)
    chunks = range(0, len(context), WINDOWS)
    hashes = [_numbers(stream, context[i : i + WINDOWS]) @ _FACTORS[:-1] + _numbers(stream, scored[i : i + WINDOWS, -1]) * _FACTORS[-1] for i in chunks]
    _, one, of = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *hashes]), return_index=True, return_inverse=True)
    found = np.zeros(len(one))
    for i in range(0, len(one), WINDOWS):
        c, t = context[one[i : i + WINDOWS]], scored[one[i : i + WINDOWS]]
        found[i : i + WINDOWS] = log_probs(m, stream[np.maximum(c, 0)], c >= 0, np.where(t >= 0, stream[np.maximum(t, 0)], -1)).sum(axis=1)
    return np.bincount(text, weights=found[of], minlength=len(at) - 1)


#: Factors of the hash of a window: one for each place of its context and one for its last target; the other targets are in its context.
_FACTORS = np.random.default_rng(43).integers(-(1 << 62), 1 << 62, CONTEXT + 1) * 2 + 1


def _numbers(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Subwords at ``places`` and 1, or 0 where a place is negative."""
    return np.where(places >= 0, stream[np.maximum(places, 0)] + 1, 0)


def with_counts(subwords: Subwords, pairs: np.ndarray, counts: np.ndarray, prior: float = 8.0) -> LanguageModel:
    """Bigram biases; ``pairs`` are previous times the vocabulary's size plus next. """
    n = np.zeros((subwords.size, subwords.size))
    n.reshape(-1)[pairs] = counts
    once = n.sum(axis=0) + 0.1
    real = np.zeros(subwords.size, dtype=bool)
    real[: len(subwords.ranks) + 1] = True
    once = np.where(real, once, 0)
    p = (n + prior * once / once.sum()) / (n.sum(axis=1, keepdims=True) + prior)
    p = p.reshape(subwords.size, *subwords.shape)
    of = [p.sum(axis=2), p]
    before = [np.ones(subwords.size), of[0]]
    biases = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, y in zip(of, before):
            y = y[..., None]
            logs = np.maximum(np.log(np.where(y > 0, x / y, 0)), -60).reshape(subwords.size, -1, x.shape[-1])
            biases.append(np.ascontiguousarray(logs.transpose(1, 0, 2)).astype(np.float32))
    return LanguageModel(subwords, biases)


def _sums_of_runs(rows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by ``ids``, which ascend, as a table of ``size`` rows."""
    first = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
    total = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    # Two numbers at a time, as the parts of a complex one: that is twice as fast.
    total[ids[first]] = np.add.reduceat(rows.view(np.result_type(rows.dtype, np.complex64)), first, axis=0).view(rows.dtype)
    return total


def _gradients(m: LanguageModel, ids: np.ndarray, real: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of ``targets`` (windows, places; negative: none), of every weight."""
    s, w, asked = m.subwords, m.weights, targets.shape[1]
    kind = w["embed"].dtype
    every, parts = _forward(m, ids, real, asked)
    rows, previous, target = _targets(m, ids, targets)
    h, n = every.take(rows, axis=0), len(rows)
    g = {name: np.zeros_like(a) for name, a in w.items()}
    # What the right choices add to the gradients is a sum of hidden states by subword, and a row of weights looked up.
    by_target = _sums_of_runs(h, target, s.size).reshape(*s.shape, WIDTH) / kind.type(-n)
    g["digit0"][0], g["digit1"][:] = by_target.sum(axis=1).T, by_target.transpose(0, 2, 1)
    back = [np.concatenate((w[k], np.ones_like(w[k][:, :1])), axis=1) for k in _DIGITS]
    right = ((w["digit0"][0].T[:, None] + w["digit1"].transpose(0, 2, 1)) / kind.type(-n)).reshape(-1, WIDTH)
    # From here on a place is a column: factors of places then run along the long side.
    columns = np.ascontiguousarray(h.T)
    dt, product, scaled = right.T.take(target, axis=1), np.empty((WIDTH + 1) * _ROWS, dtype=kind), np.empty(WIDTH * _ROWS, dtype=kind)
    for own, z, _, (level, group) in _choices(m, h, previous, target):
        np.exp(z, out=z)
        # Unnormalised: the last row has the sums, by which the others are divided.
        y = np.matmul(back[_DIGITS.index(level)][group], z.T, out=product[: (WIDTH + 1) * len(z)].reshape(WIDTH + 1, -1))
        share = 1 / (n * y[WIDTH])
        x = np.multiply(columns[:, own], share, out=scaled[: WIDTH * len(z)].reshape(WIDTH, -1))
        g[level][group] += x @ z
        y = y[:WIDTH]
        y *= share
        dt[:, own] += y
    columns *= columns
    np.subtract(1, columns, out=columns)
    columns *= dt
    if n == len(every):
        at = np.empty_like(rows)
        at[rows] = np.arange(n)
        np.ascontiguousarray(columns.T).take(at, axis=0, out=every, mode="clip")
    else:
        every[:] = 0
        every[rows] = columns.T
    by_place = np.zeros((asked, CONTEXT), dtype=kind)
    # Gradients of key, value, query and direct input of each place, side by side.
    every_place = np.empty((len(ids), CONTEXT, 4, WIDTH), dtype=kind)
    every_place[:, : CONTEXT - asked, 2:] = 0
    every_place[:, -asked:, 3] = every.reshape(len(ids), asked, WIDTH)
    g["o"] = np.concatenate([part["o"] for part in parts]).T @ every
    for part, start in zip(parts, range(0, len(ids), _AT_ONCE)):
        own = ids[start : start + _AT_ONCE]
        dz = every[start * asked : (start + len(own)) * asked]
        do = dz @ w["o"].T
        # With unnormalised attention e of sum ``size``, the gradient of a logit is e / size times what its value exceeds the mean by.
        mean = _sums(do * part["o"]) / part["size"]
        do /= part["size"][:, None]
        do = do.reshape(len(own), asked, WIDTH)
        d = np.matmul(do, part["v"].transpose(0, 2, 1))
        d -= mean.reshape(len(own), asked, 1)
        d *= part["e"]
        by_place += (np.ones(len(own), dtype=kind) @ d.reshape(len(own), -1)).reshape(asked, CONTEXT)
        each = every_place[start : start + len(own)]
        np.matmul(d.transpose(0, 2, 1), part["q"], out=each[:, :, 0])
        np.matmul(part["e"].transpose(0, 2, 1), do, out=each[:, :, 1])
        np.matmul(d, part["k"], out=each[:, -asked:, 2])
    flat = ids.reshape(-1).astype(np.uint16) if s.size < 1 << 16 else ids.reshape(-1)
    order = np.argsort(flat, kind="stable")
    by_id = _sums_of_runs(every_place.reshape(-1, 4 * WIDTH).take(order, axis=0), flat[order], s.size)
    by_id[:, 2 * WIDTH : 3 * WIDTH] *= WIDTH**-0.5
    g["near"] = np.bincount(np.maximum(_BEHIND, 0)[-asked:].reshape(-1), weights=by_place.reshape(-1), minlength=CONTEXT).astype(kind)
    g |= zip("kvqx", np.split(w["embed"].T @ by_id, 4, axis=1))
    g["embed"] = by_id @ np.concatenate([w[k].T for k in "kvqx"])
    return g


class Adam:
    """Keeps all weights in one vector, of which those of the model become views."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.names, self.step = list(w), 0
        self.all = np.concatenate([w[k].reshape(-1) for k in self.names])
        at = 0
        for k in self.names:
            w[k] = self.all[at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
        self.mean, self.square, self.g, self.root = (np.zeros_like(self.all) for _ in range(4))
        self.digits = [w[k] for k in _DIGITS]

    def update(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        np.concatenate([g[k].reshape(-1) for k in self.names], out=self.g)
        self.mean *= 0.9
        self.mean += np.multiply(self.g, 0.1, out=self.root)
        self.square *= 0.99
        np.multiply(self.g, self.g, out=self.g)
        self.g *= 0.01
        self.square += self.g
        np.multiply(self.square, 1 / (1 - 0.99**self.step), out=self.root)
        np.sqrt(self.root, out=self.root)
        self.root += 1e-8
        np.multiply(self.mean, rate / (1 - 0.9**self.step), out=self.g)
        self.g /= self.root
        self.all -= self.g
        for x in self.digits:
            np.clip(x, -_MOST_WEIGHT, _MOST_WEIGHT, out=x)


def train(m: LanguageModel, texts: list[bytes], steps: int = 600, windows: int = 32, seed: int = 5) -> LanguageModel:
    """Adds the attention layer's weights, by Adam on random windows of ``texts``."""
    if not texts:
        return m
    s, rng = m.subwords, np.random.default_rng(seed)
    stream, at = Tokens(texts, s).streams()
    context, scored = _whole_windows(stream, at)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m.weights = {"embed": draw(s.size, WIDTH, scale=0.3), "near": np.zeros(CONTEXT, dtype=np.float32), **{k: draw(WIDTH, WIDTH, scale=0.25) for k in "qkvox"}, **{k: draw(int(np.prod(s.shape[:i])), WIDTH, s.shape[i], scale=0.02) for i, k in enumerate(_DIGITS)}}
    adam = Adam(m.weights)
    for step in range(1, steps + 1):
        own = rng.integers(0, len(context), windows)
        c, t = context[own], scored[own]
        g = _gradients(m, stream[np.maximum(c, 0)], c >= 0, np.where(t >= 0, stream[np.maximum(t, 0)], -1))
        adam.update(g, 0.01 * min(1.0, 1.5 * (1 - step / (steps + 1))))
    return m


def train_on_all(streams: DataFrame, m: LanguageModel, documents: int) -> LanguageModel:
    """The weights after one pass over every subword of ``streams`` (doc_id, stream), of so many documents: shards of documents train apart from ``m`` on, and the mean over shards, weighted by targets, stands.

    Documents are dealt to shards by hash and read in hash order, so the result
    does not follow the layout of files. Sums are added up in two levels; the
    driver gets a few rows of the weights' size whatever the number of shards.
    """
    if not m.weights:
        return m
    shards = max(1, -(-documents // SHARD_DOCUMENTS))
    shared = streams.sparkSession.sparkContext.broadcast(m)
    names = list(m.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = LanguageModel(start.subwords, start.biases, {k: a.copy() for k, a in start.weights.items()})
        adam, n, kind = Adam(own.weights), 0, stream_type(own.subwords)
        for batch in batches:
            texts = batch.column("stream").to_pylist()
            for a, b in _groups(texts, _TEXTS_BYTES):
                stream = np.frombuffer(b"".join(texts[a:b]), dtype=kind).astype(np.int64)
                context, scored = _whole_windows(stream, np.cumsum([0] + [len(t) // kind.itemsize for t in texts[a:b]]))
                order = np.random.default_rng(len(context)).permutation(len(context))
                for i in range(0, len(order), TRAIN_WINDOWS):
                    c, t = context[order[i : i + TRAIN_WINDOWS]], scored[order[i : i + TRAIN_WINDOWS]]
                    targets = np.where(t >= 0, stream[np.maximum(t, 0)], -1)
                    adam.update(_gradients(own, stream[np.maximum(c, 0)], c >= 0, targets), 0.004 / (1 + adam.step / 50) ** 0.5)
                    n += int((targets >= 0).sum())
        if n:
            yield _sum_row(n, n * np.concatenate([own.weights[k].reshape(-1) for k in names]).astype(np.float64))

    dealt = streams.select("stream", F.xxhash64("doc_id", "stream").alias("_o")).repartition(shards, "_o").sortWithinPartitions("_o").select("stream")
    sums = dealt.mapInArrow(run, _SUM).repartition(max(1, min(16, shards // 16)), F.xxhash64("sums")).mapInArrow(_add_up, _SUM).toArrow()
    total = sum(sums.column("n").to_pylist())
    if total:
        flat = sum(np.frombuffer(x) for x in sums.column("sums").to_pylist()) / total
        for k in names:
            m.weights[k], flat = flat[: m.weights[k].size].reshape(m.weights[k].shape).astype(np.float32), flat[m.weights[k].size :]
    return m


def _sum_row(n: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, 0.0
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist()):
            n, sums = n + k, sums + np.frombuffer(x)
    if n:
        yield _sum_row(n, sums)


# ---- counts over the corpus


_COUNTS = "bucket int, keys binary, counts binary, doc_id long"
#: Buckets that have no words: pairs of subwords, and whole texts as subwords.
_PAIRS, _STREAMS = -1, -2


def corpus_counts(docs: DataFrame, subwords: Subwords, buckets: int) -> DataFrame:
    """Partial counts of tasks: (bucket, keys, counts) with word hashes dealt to buckets; and the subwords of each document with its doc_id."""
    bounded_batches(docs.sparkSession)

    def row(bucket: list[int], keys: list[bytes], counts: list[bytes], ids: list[int | None]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(ids, pa.int64())], ["bucket", "keys", "counts", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kind = np.zeros(subwords.size**2, dtype=np.int64), stream_type(subwords)
        for batch in batches:
            texts, ids = byte_list(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in _groups(texts, _TEXTS_BYTES):
                t = Tokens(texts[a:b], subwords)
                stream, at = t.streams()
                small = stream.astype(kind).tobytes()
                yield row([_STREAMS] * (b - a), [small[kind.itemsize * x : kind.itemsize * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], [b""] * (b - a), ids[a:b])
                inside = np.ones(len(stream), dtype=bool)
                inside[at[1:] - 1] = False
                own = np.flatnonzero(inside)
                np.add(pairs, np.bincount(stream[own] * subwords.size + stream[own + 1], minlength=len(pairs)), out=pairs)
                hashes = np.append(t.hashes, np.uint64(END_HASH))
                counts = np.append(np.bincount(t.word, minlength=len(t.hashes)), b - a).astype("<u8")
                bucket = (hashes >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                part = lambda x: [x[order[cuts[i] : cuts[i + 1]]].tobytes() for i in full]
                yield row(full.tolist(), part(hashes), part(counts), [None] * len(full))
        seen = np.flatnonzero(pairs)
        if len(seen):
            yield row([_PAIRS], [seen.astype("<u8").tobytes()], [pairs[seen].astype("<u8").tobytes()], [None])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COUNTS)


def _summed(table: pa.Table) -> pa.Table:
    """Counts of the words of one bucket, of which each task sent each word once or a few times."""
    keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("counts").to_pylist()])
    distinct, of = np.unique(keys, return_inverse=True)
    return pa.table({"h": distinct.view(np.int64), "c": np.bincount(of, weights=counts, minlength=len(distinct)).astype(np.int64)})


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.record_batch([pa.array(np.frombuffer(keys, "<u8").astype(np.int64)), pa.array(np.frombuffer(counts, "<u8").astype(np.int64))], ["pair", "n"])


def score(docs: DataFrame, learn: Column, held_out: Column, ranks_file: str = RANKS_FILE, ranks: int = 1024, sample_documents: int = 256) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; learns from rows where ``learn`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    subwords = load_subwords(ranks_file, ranks)
    known = docs.where(learn)
    # A bucket's partial counts are held whole by a task: their number follows the documents.
    buckets = max(LEAST_BUCKETS, -(-known.count() // BUCKET_DOCUMENTS))
    partial = materialise(corpus_counts(known, subwords, buckets), "counts")
    counts = materialise(partial.where("bucket >= 0").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_summed, "h long, c long"), "words")
    pairs = partial.where(F.col("bucket") == _PAIRS).select("keys", "counts").mapInArrow(_pair_rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    release(spark)
    sizes = {int(r["k"]): (r["n"], r["c"]) for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    total, distinct = sum(c for _, c in sizes.values()), sum(n for n, _ in sizes.values())
    # The words of the largest counts, by powers of two, as many as a task may hold.
    level, head_size = 64, 0
    for k in sorted(sizes, reverse=True):
        if head_size + sizes[k][0] > MOST_HEAD:
            break
        level, head_size = k, head_size + sizes[k][0]
    head = counts.where(F.floor(F.log2("c")) >= level).toArrow()
    head_hash = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(head_hash)
    head_hash, head_count = head_hash[order], head.column("c").to_numpy()[order]
    sample = known.where("text is not null").select("text", F.xxhash64("doc_id").alias("_o")).orderBy("_o", "text").limit(sample_documents).toArrow()
    model = with_counts(subwords, pairs.column("pair").to_numpy(), pairs.column("n").to_numpy())
    ended = counts.where(F.col("h") == END_HASH).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    streams = partial.where(F.col("bucket") == _STREAMS).select("doc_id", F.col("keys").alias("stream"))
    model = train_on_all(streams, train(model, byte_list(sample.column("text"))), ended)
    shared = spark.sparkContext.broadcast((model, head_hash, head_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes, c = shared.value
        for batch in batches:
            texts = byte_list(batch.column("text"))
            for a, b in _groups(texts, _TEXTS_BYTES):
                t = Tokens(texts[a:b], m.subwords)
                log_prob = score_streams(m, *t.streams())
                n = np.diff(t.first)
                at = np.minimum(np.searchsorted(hashes, t.hashes), max(len(hashes) - 1, 0))
                hit = hashes[at] == t.hashes if len(hashes) else np.zeros(len(t.hashes), dtype=bool)
                logs = np.where(hit, np.log10((c[at] if len(hashes) else 0) + 1.0), 0.0)[t.word]
                text = np.repeat(np.arange(b - a), n)
                in_head = hit[t.word]
                rest = np.flatnonzero(~in_head)
                cuts = np.searchsorted(text[rest], np.arange(b - a + 1))
                tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(t.hashes[t.word[rest]].view(np.int64)))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("held_out").slice(a, b - a),
                        pa.array((n + 1).astype(np.int64)),
                        pa.array(np.bincount(text[in_head], minlength=b - a).astype(np.int64)),
                        pa.array(np.bincount(text, weights=logs, minlength=b - a)),
                        pa.array(log_prob / np.log(10)),
                        tail,
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_head", "head_logs", "score", "tail"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    scored = own.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_head long, head_logs double, score double, tail array<long>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("tail").alias("h")).join(counts, "h").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    norm = float(np.log10(total + distinct + 1.0))
    out = scored.drop("tail").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n", F.lit(0)) + (1 if ended else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) + float(np.log10(ended + 1.0)) - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )
