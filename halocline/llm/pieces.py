"""SentencePiece encoding with sampling, and decoding.

A text's lattice has a node at each character and an edge for each piece of the
vocabulary; a segmentation is a path. Pieces have probability 1 / (rank + shift),
and a path's probability is the product, normalised over all paths. The k
segmentations with the largest Gumbel-perturbed log-probabilities are k distinct
samples without replacement. They are found by A-star search top down: the whole
set of paths has one perturbed maximum; the path that attains it is a sample; the
paths that leave it at its first, second, ... piece are disjoint sets, whose
perturbed maxima are Gumbels truncated at that value; and the set with the
largest maximum is searched next. The inclusion score of a sample is the chance
that it is among the k, given the (k+1)-th perturbed value.

Random numbers are hashes of the row key and a place in the text, so a row gives
the same samples wherever and with whatever other rows it is encoded.

No piece crosses from a word into the next space, so lattices are built once for
each distinct word of a batch. Characters without a piece become byte pieces.
Spaces are written as U+2581 with one put before the text; a U+2581 of the text
itself becomes bytes, so decode(encode(x)) == x for every text.

Null and empty texts have one segmentation, without pieces. A text with fewer
than k segmentations returns all it has, with inclusion score 1. Repeated rows
with equal keys get equal samples. Other columns pass through; columns named
``samples`` or ``decoded`` are replaced. Empty tables give empty results. A long text
is one lattice, whole, and must fit a task. Of equal perturbed values, which need equal
hashes, that of the earlier sample's paths is searched first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, mixed, ragged

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for a U+2581 of the text; no code point.
LITERAL = 0x110000
SAMPLES = "array<struct<ids: array<int>, log_prob: double, perturbed: double, inclusion: double>>"
_SAMPLES_TYPE = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
_HASH, _UNIT = Rolling(31), Rolling(32)
_FILTER = 20
#: Masses of paths are kept times _SCALE for each character, up to _NEAR characters before a word's end; no float64 overflows or underflows by then.
_SCALE, _NEAR = float(np.exp(5.0)), 14
#: Characters whose words share a lattice, unless one text has more; bounds a task's memory.
_LATTICE_CHARS = 1 << 17
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by hash of their characters; log-probabilities by id; bytes of each id.

    ``slots`` has, by the leading bits of a hash, which of the sorted ``hashes``
    that is: -1 for none, -2 for several.
    """

    hashes: np.ndarray
    ids: np.ndarray
    slots: np.ndarray
    longest: int
    #: Probabilities by id, times _SCALE for each character of the piece.
    scaled: np.ndarray
    #: By length: which hashes of that many characters begin a longer piece.
    begins: dict[int, np.ndarray]
    log_prob: np.ndarray
    byte_ids: np.ndarray
    text: pa.LargeBinaryArray


def _values(chars: np.ndarray) -> np.ndarray:
    """What is hashed for each character: over 0, since a zero adds nothing to a span but its length, and "=\\0" was the piece ">"."""
    return chars.astype(np.uint64) + np.uint64(1)


def load(path: str = MODEL_FILE, shift: float = 10.0) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    log_prob, width = -np.log(np.arange(n) + shift), np.zeros(n, dtype=np.int64)
    byte_ids, text, by_length = np.zeros(256, dtype=np.int64), [b""] * n, {}
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text[i] = piece.replace("▁", " ").encode()
            if "▁" not in piece.lstrip("▁"):
                by_length.setdefault(len(piece), []).append((piece, i))
                width[i] = len(piece)
    log_prob[byte_ids] = -np.log(n + shift)
    hashes, ids = [], []
    for length, pieces in by_length.items():
        chars = _values(np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le"), dtype=np.uint32))
        starts = np.arange(len(pieces)) * length
        hashes.append(_HASH.spans(chars, starts, starts + length))
        ids.append([i for _, i in pieces])
    hashes, ids = np.concatenate(hashes), np.concatenate(ids).astype(np.int32)
    order = np.argsort(hashes)
    hashes, ids = hashes[order], ids[order]
    slot = (hashes >> np.uint64(64 - _FILTER)).astype(np.int64)
    slots = np.full(1 << _FILTER, -1, dtype=np.int32)
    slots[slot] = np.arange(len(slot))
    slots[slot[1:][slot[1:] == slot[:-1]]] = -2
    begins = {}
    for length in range(1, max(by_length)):
        begins[length] = np.zeros(1 << _FILTER, dtype=bool)
        heads = "".join({p[:length] for longer, pieces in by_length.items() if longer > length for p, _ in pieces})
        chars = _values(np.frombuffer(heads.encode("utf-32-le"), dtype=np.uint32))
        starts = np.arange(len(chars) // length) * length
        begins[length][(_HASH.spans(chars, starts, starts + length) >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
    log_prob -= np.log(np.exp(log_prob).sum())
    return Vocabulary(hashes, ids, slots, max(by_length), np.exp(log_prob) * _SCALE**width, begins, log_prob, byte_ids, pa.array(text, pa.large_binary()))


def _chars(text: str) -> np.ndarray:
    c = np.frombuffer((" " + text).encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    c[c == SPACE] = LITERAL
    c[c == 32] = SPACE
    return c


def _seeds(keys: np.ndarray, tag: int) -> np.ndarray:
    """A seed for each row key and tag."""
    return mixed(keys + np.uint64((0x9E3779B97F4A7C15 * (2 * tag + 1)) & 0xFFFFFFFFFFFFFFFF))


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and the place only."""
    h = mixed(seed ^ (place.astype(np.uint64) * _GOLDEN))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _stable(values: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers under ``below``; numpy sorts those of two bytes by radix."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


class Lattice:
    """Lattices of the distinct words of some texts, end to end, with edge probabilities given the node."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        parts = [_chars(t) if t else np.zeros(0, dtype=np.uint32) for t in texts]
        chars = np.concatenate([np.zeros(0, np.uint32), *parts])
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        space = chars == SPACE
        opens = space & ~np.concatenate(([False], space[:-1])) if len(chars) else space
        opens[self.at[:-1][np.diff(self.at) > 0]] = True
        self.start = np.flatnonzero(opens)
        ends = np.append(self.start[1:], len(chars))
        self.doc_first = np.searchsorted(self.start, self.at)
        self.vocabulary = vocabulary
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.doc_first))
        _, first, self.unit = np.unique(_UNIT.spans(_values(chars), self.start, ends), return_index=True, return_inverse=True)
        size = (ends - self.start)[first]
        # Node numbers: the characters of distinct words end to end, with an end node after each word.
        self.base = np.cumsum(size + 1) - (size + 1)
        self.last = self.base + size
        total = int((size + 1).sum())
        node_char = np.zeros(total, dtype=np.uint32)
        inside = np.ones(total, dtype=bool)
        inside[self.last] = False
        nodes = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(size)), size)
        node_char[nodes] = chars[nodes - self.base[word] + self.start[first][word]]
        distance = np.zeros(total, dtype=np.int32)
        distance[nodes] = self.last[word] - nodes
        self._edges(node_char, nodes, self.last[word])
        self._backward(distance)
        self._bytes(node_char)

    def _edges(self, chars: np.ndarray, nodes: np.ndarray, end: np.ndarray) -> None:
        v = self.vocabulary
        src, dst, ids = [], [], []
        single = np.zeros(len(chars), dtype=bool)
        own, sums = nodes, _HASH.sums(_values(chars))
        for length in range(1, v.longest + 1):
            inside = own + length <= end
            own, end = own[inside], end[inside]
            if not len(own):
                break
            h = _HASH.between(sums, own, own + length)
            slot = (h >> np.uint64(64 - _FILTER)).astype(np.int64)
            k = v.slots[slot]
            several = np.flatnonzero(k == -2)
            k[several] = np.minimum(np.searchsorted(v.hashes, h[several]), len(v.hashes) - 1)
            near = np.flatnonzero(k >= 0)
            near = near[v.hashes[k[near]] == h[near]]
            src.append(own[near])
            dst.append(own[near] + length)
            ids.append(v.ids[k[near]])
            if length == 1:
                single[src[-1]] = True
            if length in v.begins:
                longer = v.begins[length][slot]
                own, end = own[longer], end[longer]
        bare = nodes[~single[nodes]]
        c = chars[bare]
        n_bytes = np.where(c == LITERAL, 3, 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        src, dst, ids = [*src, bare], [*dst, bare + 1], [*ids, np.full(len(bare), -1, dtype=np.int32)]
        # A node has one piece of each length at most, so edges are dealt to their nodes a length at a time.
        self.degree = np.zeros(len(chars), dtype=np.int32)
        for x in src:
            self.degree[x] += 1
        self.first = np.concatenate(([0], np.cumsum(self.degree, dtype=np.int64)))
        free = self.first[:-1].copy()
        total = int(self.first[-1])
        self.src, self.dst, self.ids = (np.empty(total, dtype=np.int32) for _ in range(3))
        self.weight = np.empty(total)
        for x, y, z in zip(src, dst, ids):
            at = free[x]
            free[x] += 1
            self.src[at], self.dst[at], self.ids[at] = x, y, z
            self.weight[at] = v.scaled[z] if len(z) and z[0] >= 0 else 0.0
        self.weight[self.first[bare + 1] - 1] = np.exp(v.log_prob[v.byte_ids[0]] * n_bytes) * _SCALE

    def _backward(self, distance: np.ndarray) -> None:
        """Chance of each edge given its node, from the mass of the paths from each node to the end of its word, nearest to the end first.

        Masses are numbers up to _NEAR characters from the end, and logarithms beyond.
        """
        level = distance[self.src]
        level = level.astype(np.uint16) if not len(level) or level.max() < 1 << 16 else level
        order = np.argsort(level, kind="stable")
        level = level[order]
        src, dst, weight = self.src[order], self.dst[order], self.weight[order]
        cuts = np.flatnonzero(np.diff(level, prepend=0, append=0))
        opens = np.flatnonzero(np.diff(src, prepend=-1))
        bounds = np.searchsorted(opens, cuts)
        mass, far = np.ones(len(distance)), np.zeros(0)
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            own = opens[bounds[i] : bounds[i + 1]]
            if level[a] <= _NEAR:
                value = mass[dst[a:b]]
                value *= weight[a:b]
                mass[src[own]] = np.add.reduceat(value, own - a)
            else:
                if not len(far):
                    far = np.log(mass)
                value = far[dst[a:b]] + np.log(weight[a:b])
                top = np.maximum.reduceat(value, own - a)
                value -= np.repeat(top, np.diff(np.append(own, b)))
                far[src[own]] = top + np.log(np.add.reduceat(np.exp(value), own - a))
        p = mass[self.dst]
        p *= self.weight
        p /= mass[self.src]
        if len(far):
            beyond = np.flatnonzero(distance[self.src] > _NEAR)
            p[beyond] = np.exp(np.log(self.weight[beyond]) + far[self.dst[beyond]] - far[self.src[beyond]])
        del self.weight
        # The likeliest edge of a node comes first: most draws end there.
        own = np.flatnonzero(self.degree)
        lead = self.first[own]
        if len(lead):
            best = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, lead), self.degree[own]))
            best = best[np.diff(self.src[best], prepend=-1) > 0]
            for a in (self.dst, self.ids, p):
                a[lead], a[best] = a[best], a[lead]
        self.chance = p
        before = np.cumsum(p) - p
        self.run = before - np.repeat(before[lead], self.degree[own]) + p
        self.run[self.first[1:][own] - 1] = 2.0

    def _bytes(self, chars: np.ndarray) -> None:
        """Byte pieces of the edges without a piece."""
        self.parts = np.ones(len(self.ids), dtype=np.int8)
        bare = np.flatnonzero(self.ids < 0)
        codes = chars[self.src[bare]]
        distinct, of = np.unique(codes, return_inverse=True)
        raw = [chr(SPACE if c == LITERAL else c).encode("utf-8", "replace") for c in distinct.tolist()]
        self.parts[bare] = np.array([len(b) for b in raw], dtype=np.int8)[of] if len(bare) else 0
        table = np.zeros((max(1, len(raw)), 4), dtype=np.int64)
        for i, b in enumerate(raw):
            table[i, : len(b)] = self.vocabulary.byte_ids[list(b)]
        # Rows of the table stand where a piece's id would, below zero.
        self.byte_table = table
        self.ids[bare] = -1 - of

    def walk(self, occurrence: np.ndarray, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from a node of each word occurrence to its end: edges, and the index of the occurrence each is for, in order."""
        base, last = self.base[self.unit[occurrence]], self.last[self.unit[occurrence]]
        offset = self.start[occurrence] - self.at[self.doc[occurrence]] - base
        alive = np.flatnonzero(node < last)
        node = node.copy()
        edges, owners = [], []
        while len(alive):
            at = node[alive]
            u = _uniform(seed[alive], offset[alive] + at)
            e = self.first[at]
            past = np.flatnonzero(u > self.run[e])
            while len(past):
                e[past] += 1
                past = past[u[past] > self.run[e[past]]]
            edges.append(e)
            owners.append(alive)
            node[alive] = self.dst[e]
            alive = alive[node[alive] < last[alive]]
        if not edges:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        edges, owners = np.concatenate(edges), np.concatenate(owners)
        order = _stable(owners, len(occurrence))
        return edges[order], owners[order]

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.ids[edges]
        own = np.flatnonzero(ids < 0)
        if not len(own):
            return ids
        parts = self.parts[edges].astype(np.int64)
        out = np.repeat(ids, parts)
        first = (np.cumsum(parts) - parts)[own]
        at = ragged(first, parts[own])
        out[at] = self.byte_table[np.repeat(-1 - ids[own], parts[own]), at - np.repeat(first, parts[own])]
        return out


def _gumbel_max(log_mass: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels with these locations, truncated at ``below``."""
    return -np.logaddexp(-below, np.log(-np.log(u)) - log_mass)


class _Paths:
    """One sample of each of some texts, with the perturbed maxima of the sets of paths that leave it at each piece.

    Of text d: edges[first[d]:first[d+1]]; sets that leave before ``since`` belong
    to other samples, and at ``since`` the edges in ``barred`` are taken.
    """

    def __init__(self, lattice: Lattice, keys: np.ndarray, edges: np.ndarray, owner: np.ndarray, perturbed: np.ndarray, tag: int, since: np.ndarray, barred: np.ndarray):
        n = len(keys)
        self.edges, self.owner, self.perturbed, self.since, self.barred = edges, owner, perturbed, since, barred
        doc = lattice.doc[owner]
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.present = np.diff(self.first) > 0
        lc = np.log(lattice.chance[edges])
        total = np.concatenate(([0.0], np.cumsum(lc)))
        self.log_prob = total[self.first[1:]] - total[self.first[:-1]]
        # The chance of another edge than those taken.
        other, open_ = 1.0 - lattice.chance[edges], lattice.degree[lattice.src[edges]] > 1
        own = np.flatnonzero(self.present)
        at = self.first[own] + since[own]
        used = np.where(barred >= 0, lattice.chance[np.maximum(barred, 0)] if len(lattice.chance) else 0.0, 0.0).sum(axis=1)
        other[at] -= used[own]
        open_[at] &= lattice.degree[lattice.src[edges[at]]] > 1 + (barred[own] >= 0).sum(axis=1)
        live = np.flatnonzero(open_ & (other > 1e-300) & (np.arange(len(edges)) >= (self.first[:-1] + since)[doc]))
        self.place = lambda i: lattice.start[owner[i]] - lattice.at[doc[i]] + lattice.src[edges[i]] - lattice.base[lattice.unit[owner[i]]]
        mass = total[live] - total[self.first[doc[live]]] + np.log(other[live])
        self.bounds = np.full(len(edges), -np.inf)
        self.bounds[live] = _gumbel_max(mass, perturbed[doc[live]], _uniform(_seeds(keys, 2 * tag + 1)[doc[live]], self.place(live)))
        self.refresh()

    def refresh(self) -> None:
        """best: the largest bound of each text; at: where it is."""
        own = np.flatnonzero(self.present)
        self.best, self.at = np.full(len(self.present), -np.inf), np.zeros(len(self.present), dtype=np.int64)
        if len(own):
            self.best[own] = np.maximum.reduceat(self.bounds, self.first[own])
            hit = np.flatnonzero(self.bounds == np.repeat(self.best, np.diff(self.first)))
            of = np.searchsorted(self.first, hit, "right") - 1
            self.at[of[::-1]] = hit[::-1]


def _alternatives(lattice: Lattice, node: np.ndarray, barred: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge of each node that isn't barred, drawn by u."""
    count = lattice.degree[node]
    edges, of = ragged(lattice.first[node], count), np.repeat(np.arange(len(node)), count)
    p = lattice.chance[edges]
    for column in barred.T:
        p[edges == column[of]] = 0.0
    upto = np.cumsum(p)
    end = np.cumsum(count)
    before = np.where(end - count > 0, upto[end - count - 1], 0.0)
    pick = np.clip(np.searchsorted(upto, before + u * (upto[end - 1] - before), "right"), end - count, end - 1)
    for i in np.flatnonzero(p[pick] == 0.0).tolist():  # a draw at the very end
        pick[i] = end[i] - count[i] + int(p[end[i] - count[i] : end[i]].argmax())
    return edges[pick]


def _search(lattice: Lattice, keys: np.ndarray, k: int) -> tuple[list[_Paths], np.ndarray]:
    """Up to k samples of each text, in rounds of one each, and the perturbed maximum of what is left."""
    n = len(keys)
    every = np.arange(len(lattice.start))
    edges, owner = lattice.walk(every, lattice.base[lattice.unit], _seeds(keys, 0)[lattice.doc])
    top = -np.log(-np.log(_uniform(_seeds(keys, 1 << 20), np.zeros(n))))
    rounds = [_Paths(lattice, keys, edges, owner, top, 0, np.zeros(n, dtype=np.int64), np.full((n, 1), -1))]
    while True:
        best = np.stack([r.best for r in rounds])
        of = best.argmax(axis=0)
        bound = best[of, np.arange(n)]
        docs = np.flatnonzero(bound > -np.inf)
        if len(rounds) == k or not len(docs):
            return rounds, bound
        tag = len(rounds)
        parts_e, parts_o = [], []
        barred, since = np.full((n, tag + 1), -1), np.zeros(n, dtype=np.int64)
        for r, path in enumerate(rounds):
            own = docs[of[docs] == r]
            if not len(own):
                continue
            at = path.at[own]
            path.bounds[at] = -np.inf
            since[own] = at - path.first[own]
            again = since[own] == path.since[own]
            barred[own, 0] = path.edges[at]
            barred[own, 1 : path.barred.shape[1] + 1] = np.where(again[:, None], path.barred[own], -1)[:, : tag]
            u = _uniform(_seeds(keys, 2 * tag)[own], path.place(at))
            new = _alternatives(lattice, lattice.src[path.edges[at]].astype(np.int64), barred[own], u)
            word = path.owner[at]
            kept = ragged(path.first[own], since[own])
            count = lattice.doc_first[own + 1] - word
            rest = ragged(word, count)
            begin = lattice.base[lattice.unit[rest]].copy()
            begin[np.cumsum(count) - count] = lattice.dst[new]
            more, which = lattice.walk(rest, begin, _seeds(keys, 2 * tag)[lattice.doc[rest]])
            parts_e += [path.edges[kept], new, more]
            parts_o += [path.owner[kept], word, rest[which]]
        for r in {int(x) for x in of[docs]}:
            rounds[r].refresh()
        edges, owner = np.concatenate(parts_e), np.concatenate(parts_o)
        order = _stable(owner, len(lattice.start))
        rounds.append(_Paths(lattice, keys, edges[order], owner[order], bound, tag, since, barred))


def _as_arrow(lattice: Lattice, rounds: list[_Paths], limit: np.ndarray) -> pa.ListArray:
    """Samples of each text, best perturbed value first; a text without pieces has one empty sample."""
    n = len(limit)
    doc, size, columns, ids = [], [], [], []
    bare = np.flatnonzero(~rounds[0].present)
    for number, r in enumerate(rounds):
        own = np.flatnonzero(r.present)
        ids.append(lattice.piece_ids(r.edges))
        parts = np.concatenate(([0], np.cumsum(lattice.parts[r.edges], dtype=np.int64)))
        size.append((parts[r.first[1:]] - parts[r.first[:-1]])[own])
        with np.errstate(over="ignore"):
            inclusion = np.where(limit > -np.inf, -np.expm1(-np.exp(np.minimum(700.0, r.log_prob - limit))), 1.0)
        columns.append(np.stack((np.full(len(own), float(number)), r.log_prob[own], r.perturbed[own], inclusion[own])))
        doc.append(own)
    doc.append(bare)
    size.append(np.zeros(len(bare), dtype=np.int64))
    columns.append(np.repeat([[0.0], [0.0], [0.0], [1.0]], len(bare), axis=1))
    doc, size, columns, ids = np.concatenate(doc), np.concatenate(size), np.concatenate(columns, axis=1), np.concatenate(ids)
    order = np.lexsort((columns[0], doc))
    first = (np.cumsum(size) - size)[order]
    flat = ids[ragged(first, size[order])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[order]))).astype(np.int32)), pa.array(flat))
    rows = pa.StructArray.from_arrays([lists, *(pa.array(c[order]) for c in columns[1:])], ["ids", "log_prob", "perturbed", "inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)), rows)


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts that share a lattice, at least one text each."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= _LATTICE_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def sample(texts: list[str | None], keys: np.ndarray, vocabulary: Vocabulary, k: int) -> Iterator[pa.ListArray]:
    """Up to k segmentations of each text, in arrays for some neighbouring texts each; ``keys`` are unsigned 64-bit row keys."""
    for start, stop in groups(texts):
        lattice = Lattice([t or "" for t in texts[start:stop]], vocabulary)
        found = _search(lattice, keys[start:stop], k)
        samples = _as_arrow(lattice, *found)
        del lattice, found  # before the caller works on the samples
        yield samples.cast(_SAMPLES_TYPE)


def detokenise(ids: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The texts of ids[cuts[i]:cuts[i + 1]]."""
    joined = vocabulary.text.take(pa.array(ids))
    _, ends, data = joined.buffers()
    raw = data.to_pybytes() if len(ids) and data else b""
    at = np.frombuffer(ends, dtype=np.int64)[cuts].tolist() if len(ids) else [0] * len(cuts)
    # The first byte is the space put before the text.
    return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def decoded_texts(rows: pa.Array, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray]:
    """The texts of all lists of ids in ``rows``, an array of arrays of ids, end to end; and how many each row has."""
    lists = rows.flatten()
    ids = lists.flatten().to_numpy()
    return detokenise(ids, np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())), vocabulary), rows.value_lengths().fill_null(0).to_numpy()


def round_trips(samples: pa.ListArray, texts: list[str | None], vocabulary: Vocabulary) -> list[bool]:
    """Whether every sample of a text decodes to that text."""
    ids = pa.ListArray.from_arrays(samples.offsets, samples.values.field("ids"))
    decoded, sizes = decoded_texts(ids, vocabulary)
    ends = np.cumsum(sizes).tolist()
    return [all(d == (t or "") for d in decoded[e - n : e]) for t, n, e in zip(texts, sizes.tolist(), ends)]


def _keys(keys: pa.Array) -> np.ndarray:
    return mixed(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def encode(docs: DataFrame, key: Column, k: int = 2, model_file: str = MODEL_FILE) -> DataFrame:
    """``docs`` with ``samples``: up to k distinct segmentations of text, sampled by the integer ``key``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load(model_file))

    @F.arrow_udf(SAMPLES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            yield pa.concat_arrays([pa.array([], _SAMPLES_TYPE), *sample(texts.to_pylist(), _keys(keys), shared.value, k)])

    return docs.withColumn("samples", run("text", F.coalesce(key.cast("long"), F.lit(0))))


def encode_checked(docs: DataFrame, key: Column, k: int = 2, model_file: str = MODEL_FILE) -> DataFrame:
    """``docs`` with ``samples`` as ``encode`` gives them and ``round_trip``: whether each decodes to the text.

    Both in one pass of one worker, group by group, so that a task holds one
    vocabulary and the decoded texts never leave it. A column named ``round_trip``
    is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load(model_file))

    @F.arrow_udf(f"struct<samples: {SAMPLES}, round_trip: boolean>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, keys in batches:
            texts, own = column.to_pylist(), _keys(keys)
            del column
            samples, good = [pa.array([], _SAMPLES_TYPE)], []
            for part in sample(texts, own, shared.value, k):
                good += round_trips(part, texts[len(good) : len(good) + len(part)], shared.value)
                samples.append(part)
            yield pa.StructArray.from_arrays([pa.concat_arrays(samples), pa.array(good, pa.bool_())], ["samples", "round_trip"])

    coded = run("text", F.coalesce(key.cast("long"), F.lit(0)))
    return docs.withColumn("samples", coded).withColumns({"round_trip": F.col("samples.round_trip"), "samples": F.col("samples.samples")})


def decode(docs: DataFrame, ids: Column, model_file: str = MODEL_FILE) -> DataFrame:
    """``docs`` with ``decoded``: the text of each list of piece ids in ``ids``, an array of arrays."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load(model_file))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            texts, sizes = decoded_texts(pa.concat_arrays([rows]), shared.value)
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(texts, pa.string()))

    return docs.withColumn("decoded", run(ids))
