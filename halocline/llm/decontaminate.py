"""Benchmark decontamination by the q-gram lemma.

An item of n characters within e edits of a passage shares at least
n + 1 - q(e + 1) q-grams with it, on diagonals (position in the text less
position in the item) that differ by e at most. Shared q-grams are counted in
overlapping bands of 2(e + 1) diagonals, so that each such run of diagonals lies
whole in a band; bands that meet the bound are verified by banded alignment of
the whole item with free ends in the text.

Texts and items are lower-cased and runs of white space become one space. The
edit budget is ``edit_rate`` of the item's length. Items go to the executors in
blocks of at most ``block_bytes`` of text, one pass over the documents for each,
so what is sent is bounded whatever the size of the benchmark.

A text of any length is searched whole: pairs of places that share a q-gram are
worked off in ranges that overlap by an item's length, so that memory stays in
proportion to the text. Of passages of one item that overlap the one with fewest
edits stays, of equals the earliest.

Null texts and items, and items of white space only, match nothing. Items with
equal text each match. Repeated rows are searched one by one. Other columns pass
through ``clean``. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, packed, ragged

HITS = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"
_FILTER_BITS = 22
#: Alignments, and pairs of places that share a q-gram, worked on at once.
_AT_ONCE = 256
_PAIRS = 1 << 19
#: Stands for places outside of a text; no code point.
_NOTHING = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Grams:
    """The q-grams of a block of items, by hash: entries[first[k]:first[k+1]] have the k-th hash."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray


@dataclass(frozen=True)
class Items:
    ids: list[int]
    texts: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: list[Grams]


def characters(text: str | None) -> np.ndarray:
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "replace"), dtype=np.uint32)


_HASH = Rolling(21)


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    if len(text) < q:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for i in range(0, len(text) - q + 1, 1 << 18):
        part = text[i : i + (1 << 18) + q - 1].astype(np.uint64) + np.uint64(1)
        starts = np.arange(len(part) - q + 1)
        out.append(_HASH.spans(part, starts, starts + q))
    return np.concatenate(out)


def index_items(rows: list[tuple[int, str]], q: int = 10, edit_rate: float = 0.08) -> Items:
    ids, texts, edits, bound, size = [], [], [], [], []
    for item_id, text in rows:
        t = characters(text)
        if not len(t):
            continue
        e = int(edit_rate * len(t))
        # Short items have shorter q-grams, so that the bound is one at least with the whole budget.
        own = max(1, min(q, len(t) // (e + 1), max(1, len(t) // 2)))
        ids.append(item_id)
        texts.append(t)
        edits.append(e)
        size.append(own)
        bound.append(max(1, len(t) + 1 - own * (e + 1)))
    grams = []
    for own in sorted(set(size)):
        h, item, at = [], [], []
        for k, t in enumerate(texts):
            if size[k] == own:
                g = gram_hashes(t, own)
                h.append(g)
                item.append(np.full(len(g), k))
                at.append(np.arange(len(g)))
        hashes, item_, at_ = np.concatenate(h), np.concatenate(item), np.concatenate(at)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        distinct, first = np.unique(hashes, return_index=True)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(distinct >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        grams.append(Grams(own, distinct, np.append(first, len(hashes)), item_[order], at_[order], seen))
    return Items(ids, texts, np.array(edits, dtype=np.int64), np.array(bound, dtype=np.int64), grams)


def _pair_groups(near: np.ndarray, counts: np.ndarray, overlap: int) -> Iterator[slice]:
    """Ranges of places with shared q-grams of about _PAIRS pairs each, overlapping by ``overlap`` characters: each passage has its places whole in one range."""
    upto, start = np.concatenate(([0], np.cumsum(counts))), 0
    while start < len(near):
        stop = max(int(np.searchsorted(upto, upto[start] + _PAIRS, "right")) - 1, int(np.searchsorted(near, near[start] + 2 * overlap, "right")))
        yield slice(start, min(stop, len(near)))
        if stop >= len(near):
            return
        start = int(np.searchsorted(near, near[stop] - overlap))


def _candidates(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items and ranges of diagonals whose band has as many shared q-grams as the bound."""
    out = []
    longest, most = max(map(len, items.texts)), int(items.edits.max())
    for g in items.grams:
        h = gram_hashes(text, g.q)
        every = np.flatnonzero(g.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(every):
            continue
        place = np.minimum(np.searchsorted(g.hashes, h[every]), len(g.hashes) - 1)
        hit = g.hashes[place] == h[every]
        every, place = every[hit], place[hit]
        for part in _pair_groups(every, g.first[place + 1] - g.first[place], longest + 2 * (most + 1)):
            near, k = every[part], place[part]
            counts = g.first[k + 1] - g.first[k]
            entry = ragged(g.first[k], counts)
            item, diagonal = g.item[entry], np.repeat(near, counts) - g.at[entry]
            width = items.edits[item] + 1
            band = np.floor_divide(diagonal, width)
            item, band, diagonal = np.tile(item, 2), np.concatenate((band, band - 1)), np.tile(diagonal, 2)
            order = np.lexsort((diagonal, band, item))
            item, band, diagonal = item[order], band[order], diagonal[order]
            new = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])))) if len(item) else np.zeros(0, int)
            n = np.diff(np.append(new, len(item)))
            full = n >= items.bound[item[new]]
            last = np.append(new, len(item))[1:] - 1
            out.append((item[new[full]], diagonal[new[full]], diagonal[last[full]]))
    if not out:
        return (np.zeros(0, int),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _banded(text: np.ndarray, item: np.ndarray, begin: np.ndarray, width: int, anchored: int | None = None) -> np.ndarray:
    """Last row of the alignments of the whole item with the text after each of ``begin``: least edits by diagonal, of ``width`` diagonals.

    Diagonal d starts d characters after ``begin`` and ends as many after begin
    plus the item's length. The start in the text is free; with ``anchored`` it is
    on that diagonal, and edits count from there. Places outside of the text match nothing.
    """
    far = np.int32(1 << 29)
    at = begin[:, None] + np.arange(len(item) + width)[None, :]
    grid = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, max(0, len(text) - 1))], _NOTHING)
    column = np.arange(width, dtype=np.int32)
    row = np.zeros((len(begin), width), dtype=np.int32)
    if anchored is not None:
        row[:] = np.where(column >= anchored, column - anchored, far)
    for i, c in enumerate(item.tolist()):
        step = row + (grid[:, i : i + width] != c)
        # The item's character alone; then characters of the text alone, a running minimum.
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        step -= column
        np.minimum.accumulate(step, axis=1, out=step)
        step += column
        row = step
    return row


def _verified(text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, e: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best passage in each band of diagonals that has one within ``e`` edits of the whole item."""
    found = []
    width = int((high - low).max()) + 2 * e + 1
    begin = np.unique(low - e)
    for i in range(0, len(begin), _AT_ONCE):
        own = begin[i : i + _AT_ONCE]
        row = _banded(text, item, own, width)
        d = row.argmin(axis=1)
        edits = row[np.arange(len(own)), d]
        ends = np.minimum(own + d + len(item), len(text))[edits <= e]
        if len(ends):
            # Back from each end: where the passage starts.
            ends, edits = np.unique(ends), None
            back = _banded(text[::-1], item[::-1], len(text) - ends - e, 2 * e + 1, anchored=e)
            n = back.argmin(axis=1)
            found += [(int(x), max(0, int(z) - (len(item) + int(k) - e)), int(z)) for x, z, k in zip(back[np.arange(len(ends)), n], ends, n) if x <= e]
    return found


def find(text: str | None, items: Items) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) of passages, in characters of the normalised text; passages of one item don't overlap."""
    t = characters(text)
    if not len(t) or not items.ids:
        return []
    item, low, high = _candidates(t, items)
    found = []
    for k in np.unique(item).tolist():
        own = np.flatnonzero(item == k)
        passages = _verified(t, items.texts[k], low[own], high[own], int(items.edits[k]))
        # Fewest edits first, then the earliest; of those taken, ends are kept in order.
        starts, ends = [], []
        for d, a, z in sorted(set(passages)):
            at = bisect_left(starts, z)
            if at and ends[at - 1] > a:
                continue
            starts.insert(at, a)
            ends.insert(at, z)
            found.append((items.ids[k], a, z, d))
    return sorted(found)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if rows and size + 4 * len(r["text"]) > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += 4 * len(r["text"])
    yield rows


def search_block(docs: DataFrame, rows: list[tuple[int, str]], q: int, edit_rate: float) -> DataFrame:
    """``docs`` with _hits: the passages of the block's items."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index_items(rows, q, edit_rate))

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item_id": i, "start": a, "end": z, "edits": d} for i, a, z, d in find(t, shared.value)] for t in texts.tolist()])

    return docs.withColumn("_hits", run("text"))


def passages(docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_rate: float = 0.08, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per passage of a benchmark item in a document."""
    own = docs.select("doc_id", "text")
    parts = [search_block(own, rows, q, edit_rate).select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.*") for rows in item_blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_rate: float = 0.08, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns as they are, whatever their names."""
    own = packed(docs, "text")
    for rows in item_blocks(benchmark, block_bytes):
        own = search_block(own, rows, q, edit_rate).where(F.size("_hits") == 0).drop("_hits")
    return own.select("_row.*")
