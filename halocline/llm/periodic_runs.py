"""Periodic runs of words by partition refinement.

A run is a stretch of words with smallest period q, two periods long at least,
that no neighbouring word extends. Positions of a text are kept in classes of
equal factors (the next ``length`` words are the same), refined from one length to
the next. A class splits by the classes of its members' successors, and only
successors in classes that are new and not the largest part of their parent are
looked at: a position is moved a number of times that grows with the logarithm of
the text, not with the length. Members of a class are linked in the order of
position. Two neighbours whose distance is the length are a square, for the factor
between them has no other occurrence in reach; squares that start side by side are
a run. Instead of looking for such distances at every length, a link remembers the
length at which it was made: when it goes, it was a square if its distance lies
between the two.

All texts of an Arrow batch are refined together in numpy; each text is a world of
its own, so there is no shuffle, and a lost task is run again alone. Memory follows
the batch, or a single text that is larger. A word stands for itself as a hash of 64
bits; two different words of one text agree with a probability of 2**-64.

Null and empty texts have no words and no runs. Rows are independent: repeated
rows and ties give equal results, an empty table an empty one. Users' columns pass
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WORD_SPLIT, Rolling, bounded_batches, byte_list, packed, word_spans

#: Bytes and rows of text that are refined together.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000
#: Classes of at most so many members are walked link by link; larger ones are found by one pass over the batch.
WALK = 24
#: Up to so many positions a step goes one by one.
FEW = 24

_WORDS = Rolling(13)


class Runs(NamedTuple):
    """Text, first word in it, length and period in words; ordered by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``keys``, ties as they come, and whether a row of that order starts a new key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    for n, k in enumerate(keys):
        k = k[order]
        new[1:] = (k[1:] != k[:-1]) | (new[1:] if n else False)
    return order, new


class Refinement:
    """Classes of equal factors over words (numbers) of texts that start at ``first`` (one more entry at the end)."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        self.length = 1
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.longest = (np.diff(first) // 2)[self.text]
        # The last word of a text has no successor: its class is then known to be its own.
        self.last = np.zeros(n, dtype=bool)
        self.last[first[1:][np.diff(first) > 0] - 1] = True
        self.next = np.full(n, -1, dtype=np.int64)
        self.before = np.full(n, -1, dtype=np.int64)
        self.made = np.ones(n, dtype=np.int32)
        order, new = _grouped(self.text, words)
        number = np.cumsum(new) - 1
        self.kind = np.empty(n, dtype=np.int64)
        self.kind[order] = number
        joined = ~new[1:]
        self.next[order[:-1][joined]] = order[1:][joined]
        self.before[order[1:][joined]] = order[:-1][joined]
        heads = order[new]
        self.size = np.concatenate((np.diff(np.append(np.flatnonzero(new), n)), np.zeros(n, dtype=np.int64)))
        self.head = np.concatenate((heads, np.zeros(n, dtype=np.int64)))
        self.classes = len(heads)
        self.squares: list[tuple[np.ndarray, int | np.ndarray]] = []
        self.small = np.arange(n)

    def _gone(self, at: np.ndarray) -> None:
        """Links of ``at`` to the next member end before the current length: those that were squares are noted."""
        far = self.next[at] - at
        square = (self.next[at] >= 0) & (self.made[at] <= far) & (far < self.length)
        if square.any():
            self.squares.append((at[square], far[square]))

    def _members(self, kinds: np.ndarray) -> np.ndarray:
        """Positions of these classes."""
        small = self.size[kinds] <= WALK
        out = []
        at = self.head[kinds[small]]
        while len(at):
            out.append(at)
            at = self.next[at]
            at = at[at >= 0]
        if not small.all():
            wanted = np.zeros(self.classes, dtype=bool)
            wanted[kinds[~small]] = True
            out.append(np.flatnonzero(wanted[self.kind]))
        return np.concatenate([np.zeros(0, dtype=np.int64), *out])

    def step(self) -> bool:
        """From ``length`` to the next; False when nothing can split any more."""
        # Positions before a member of a small class; the last word of a text counts as before the text's end.
        before = self.small[self.small > 0] - 1
        before = before[~self.last[before]]
        if self.length == 1:
            before = np.sort(np.concatenate((before, np.flatnonzero(self.last))))
        else:
            before.sort()
        self.length += 1
        before = before[(self.size[self.kind[before]] > 1) & (self.longest[before] >= self.length)]
        if not len(before):
            self.small = before
            return False
        if len(before) <= FEW and self._peel(before.tolist()):
            self.small = before
            return True
        kind = self.kind[before]
        # A last word is alone with its end, which no class number stands for.
        after = np.where(self.last[before], -1, self.kind[np.minimum(before + 1, len(self.kind) - 1)])
        order, new = _grouped(kind, after)
        moved, kind, after = before[order], kind[order], after[order]
        lead = np.flatnonzero(new)
        count = np.diff(np.append(lead, len(moved)))
        parent = kind[lead]
        # Of each parent: what stays behind, and the largest part.
        outer = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        rest = self.size[parent[outer]] - np.add.reduceat(count, outer)
        most = np.maximum.reduceat(count, outer)
        parts = np.diff(np.append(outer, len(parent)))
        of = np.repeat(np.arange(len(outer)), parts)
        ranked = np.where(count == most[of], np.arange(len(count)), len(count))
        top = np.minimum.reduceat(ranked, outer)
        # Nothing stays: the largest part keeps the class. One part that is all of its parent is no split.
        keeps = np.zeros(len(count), dtype=bool)
        keeps[top[rest == 0]] = True
        leaves = np.repeat(~keeps, count)
        moved, part = moved[leaves], np.repeat(np.arange(len(count)), count)[leaves]
        if not len(moved):
            self.small = moved
            return False
        self._unlink(moved, kind[leaves])
        fresh = np.flatnonzero(~keeps)
        number = np.full(len(count), -1, dtype=np.int64)
        number[fresh] = self.classes + np.arange(len(fresh))
        if self.classes + len(fresh) > len(self.size):
            self._room(len(fresh))
        np.subtract.at(self.size, parent[fresh], count[fresh])
        self.size[number[fresh]] = count[fresh]
        self.classes += len(fresh)
        # Members of a new class in the order of position, as they came.
        start = np.concatenate(([True], part[1:] != part[:-1]))
        self.head[number[part[start]]] = moved[start]
        self.kind[moved] = number[part]
        self.next[moved], self.before[moved] = -1, -1
        self.next[moved[:-1][~start[1:]]] = moved[1:][~start[1:]]
        self.before[moved[1:][~start[1:]]] = moved[:-1][~start[1:]]
        self.made[moved] = self.length
        # All parts but the largest are small; where the rest is not the largest, its members are listed.
        rest_is_small = (rest > 0) & (rest < most)
        large = np.zeros(len(count), dtype=bool)
        large[top[rest_is_small]] = True
        large |= keeps
        small = moved[~large[part]]
        if rest_is_small.any():
            small = np.concatenate((small, self._members(parent[outer[rest_is_small]])))
        self.small = small
        return True

    def _peel(self, moved: list[int]) -> bool:
        """The usual late step: each position leaves a class of its own, and what stays behind is not smaller. False, with nothing done, if it is another."""
        kinds = self.kind[moved].tolist()
        if len(set(kinds)) < len(kinds):
            return False
        if self.classes + len(moved) > len(self.size):
            self._room(len(moved))
        for p, kind in zip(moved, kinds):
            a, b = int(self.before[p]), int(self.next[p])
            for at, to in ((p, b), (a, p)):
                if at >= 0 and to >= 0 and self.made[at] <= to - at < self.length:
                    self.squares.append((np.array([at]), np.array([to - at])))
            if a >= 0:
                self.next[a], self.made[a] = b, self.length
            else:
                self.head[kind] = b
            if b >= 0:
                self.before[b] = a
            self.next[p] = self.before[p] = -1
            self.size[kind] -= 1
            self.kind[p] = new = self.classes
            self.size[new], self.head[new] = 1, p
            self.classes += 1
        return True

    def _room(self, more: int) -> None:
        zeros = np.zeros(max(len(self.size), more), dtype=np.int64)
        self.size, self.head = np.concatenate((self.size, zeros)), np.concatenate((self.head, zeros))

    def _unlink(self, moved: np.ndarray, kind: np.ndarray) -> None:
        """Take ``moved`` out of the lists of their classes."""
        order = np.lexsort((moved, kind))
        x = moved[order]
        taken = np.zeros(len(self.kind), dtype=bool) if len(x) > 4096 else None
        if taken is not None:
            taken[x] = True
            out = lambda i: (i >= 0) & taken[i]
        else:
            ordered = np.sort(x)
            out = lambda i: ordered[np.minimum(np.searchsorted(ordered, i), len(ordered) - 1)] == i
        left, right = self.before[x], self.next[x]
        first, last = ~out(left), ~out(right)
        # Stretches of neighbours that go together begin and end in turns.
        a, b = left[first], right[last]
        self._gone(np.concatenate((x, a[a >= 0])))
        on, back = a >= 0, b >= 0
        self.next[a[on]] = b[on]
        self.made[a[on]] = self.length
        self.before[b[back]] = a[back]
        self.head[kind[order][first][~on]] = np.where(back, b, -1)[~on]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Refine to the end; positions and periods of all squares whose root is no power."""
        while self.step():
            pass
        # Links that are left hold for good: all lengths that a text has room for.
        far = self.next - np.arange(len(self.next))
        square = (self.next >= 0) & (self.made <= far) & (far <= self.longest)
        at = np.flatnonzero(square)
        parts = [*self.squares, (at, far[at])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def find_runs(words: np.ndarray, first: np.ndarray, least: int = 12) -> Runs:
    """Runs of at least ``least`` words over texts whose words (numbers) start at ``first``."""
    if not len(words):
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none)
    state = Refinement(words, first)
    at, period = state.finish()
    order = np.lexsort((at, period, state.text[at]))
    at, period = at[order], period[order]
    text = state.text[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(at)))
    text, start, period = text[lead], at[lead], period[lead]
    length = count - 1 + 2 * period
    long_enough = length >= least
    text, start, period, length = (x[long_enough] for x in (text, start, period, length))
    order = np.lexsort((period, start, text))
    return Runs(text[order], start[order] - first[text[order]], length[order], period[order])


_FOUND = [*(StructField(x, LongType()) for x in ("n_words", "n_runs", "start", "length", "period")), StructField("runs", StringType()), StructField("collapsed", StringType())]


def _collapsed(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    words = text.split()
    if len(start):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        keep = np.cumsum(edge)[:-1] == 0
        words = [w for w, k in zip(words, keep.tolist()) if k]
    return b" ".join(words)


def runs_of(docs: DataFrame, text: Column | str = "text", least: int = 12, digests: bool = False) -> DataFrame:
    """The columns of ``docs`` in a struct ``_row`` beside n_words, n_runs; start, length and period of the longest run (ties: least start, then period;
    null without a run); ``runs``, a line ``start,length,period`` for each run by start and period; ``collapsed``, the words joined by a space without
    those that a run contains after its first period.

    ``digests`` puts the sha256 of the last two in their place, so that texts don't travel back from the workers.
    """
    bounded_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    text = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column("_text"))
            data, starts, ends, first = word_spans(texts)
            found = find_runs(_WORDS.words(data, starts, ends).view(np.int64), first, least)
            cut = np.searchsorted(found.text, np.arange(len(texts) + 1))
            rows: list[list] = [[] for _ in range(5)]
            listed, kept = [], []
            for k, t in enumerate(texts):
                own = slice(cut[k], cut[k + 1])
                start, length, period = found.start[own], found.length[own], found.period[own]
                best = int(np.argmax(length)) if len(length) else -1
                for column, v in zip(rows, (first[k + 1] - first[k], len(start), *((start[best], length[best], period[best]) if len(start) else (None,) * 3))):
                    column.append(v if v is None else int(v))
                line = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
                short = _collapsed(t, start, length, period)
                listed.append(sha256(line.encode()).hexdigest() if digests else line)
                kept.append(sha256(short).hexdigest().encode() if digests else short)
            columns = [*(pa.array(x, pa.int64()) for x in rows), pa.array(listed, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch([batch.column("_row"), *columns], ["_row", *(f.name for f in _FOUND)])

    own = packed(docs, F.coalesce(text, F.lit("")).alias("_text"))
    return own.mapInArrow(run, StructType([own.schema["_row"], *_FOUND]))


def with_repeats(text: Column, chosen: Column, place: Callable[[Column], tuple[Column, Column]]) -> Column:
    """``text``; where ``chosen`` and not without words, its words joined by a space, with each word i >= start become word start + (i - start) % period.

    ``place`` makes start and period of the number of words. A way to plant runs of known place.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1), lambda w: w != "")

    def repeated(own: Column) -> Column:
        start, period = place(F.size(own).cast("long"))
        # Start and period are bound once for a text, as the words are.
        placed = F.transform(F.array(F.struct(start.alias("a"), period.alias("p"))), lambda x: F.transform(own, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(own, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))))
        return F.when(F.size(own) > 0, F.array_join(F.get(placed, F.lit(0)), " ")).otherwise(text)

    return F.when(chosen, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)
