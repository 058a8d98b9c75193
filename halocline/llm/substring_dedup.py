"""Substring dedup: removes every word in a window of words that also starts elsewhere.

Difference-cover anchors: with a cover D modulo v, any two positions have a shift
below v that moves both onto D modulo v. Two equal windows of w words therefore
share an anchor, a shorter window of w-v+1 words that starts at a cover position
in both. Only anchors (5 of 21 positions) are hashed and shuffled at first; an
anchor that occurs twice is then extended to all windows of w words around it,
and those are compared as 96-bit hashes of the whole window. Every pair of equal
windows shares an anchor, so no pair is lost; equality is of whole windows.

Texts are packed into batches of a few MB in the shared folder. A batch sends a
hash that it holds several times once, so a passage of a third of all documents
is one row a batch, and no group holds more than one row a batch of any hash.
Hashes are dealt to buckets as packed arrays with (document, word) positions and
come back the same way, grouped by batch.

Each row of the input is a document of its own: repeated rows are copies of each
other. Null text has no words. Null doc_id is allowed. Only doc_id and text are
read. An empty table gives an empty result. Texts longer than a batch are batches of
their own and whole. There is nothing to tie: all words in repeated windows go, none
is kept as the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded_batches, byte_list, drop_materialised, materialise, release, word_spans

#: Difference covers, period to residues; every difference modulo the period occurs.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Batches whose hashes share a bucket: at most some 30 MB each, where every window repeats.
BATCHES_A_BUCKET, LEAST_BUCKETS = 4, 64
_SENT = "bucket int, batch long, once binary, doc binary, pos binary, often binary, sure_doc binary, sure_pos binary"
_FOUND = "batch long, doc binary, pos binary"
_WORD, _ANCHOR, _LOW, _HIGH = Rolling(11), Rolling(12), Rolling(13), Rolling(14)


@dataclass(frozen=True)
class Shape:
    window: int
    period: int
    buckets: int

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def shape(window: int, buckets: int) -> Shape:
    """The longest period that leaves anchors of at least 12 words, or else half of the window."""
    fitting = [v for v in COVERS if v <= window - 11] or [v for v in COVERS if v <= max(7, window // 2)]
    if window < 8:
        raise ValueError("a window has 8 words at least")
    return Shape(window, max(fitting), buckets)


def pack(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """One row per batch: batch, doc_ids, lengths in bytes, and the compressed texts end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, n = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.record_batch([pa.array([(part << 32) + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(texts))], pa.binary())], ["batch", "doc_ids", "lengths", "data"])

        for rows in batches:
            for i, t in zip(rows.column("doc_id").to_pylist(), byte_list(rows.column("text"))):
                if texts and size + len(t) > batch_bytes:
                    yield full()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield full()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "batch long, doc_ids array<long>, lengths array<long>, data binary")


def _unpack(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, sum(row["lengths"])))
    ends = np.cumsum(row["lengths"]).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _bytes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte: equal high bytes compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _join_numbers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype="<u8"), *(_numbers(x, width) for x in column.to_pylist() if x)])


def _deal(batch: int, low: np.ndarray, high: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, buckets: int, width: int) -> pa.Table:
    """Rows for the buckets of one batch: hashes held once with their place; hashes held often, once; the places of those."""
    order = np.argsort(low, kind="stable")
    low, doc, pos = low[order], doc[order], pos[order]
    high = high[order] if high is not None else np.zeros(len(low), dtype=np.uint64)
    same = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    if high is not None and ((low[1:] == low[:-1]) & ~same).any():
        order = np.lexsort((high, low))
        low, high, doc, pos = low[order], high[order], doc[order], pos[order]
        same = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    often, first = before | after, after & ~before
    bucket = ((low >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rows: list[list] = [[] for _ in range(8)]
    for b in range(buckets):
        own = by[cuts[b] : cuts[b + 1]]
        if len(own):
            one, several, lead = own[~often[own]], own[often[own]], own[first[own]]
            hashes = lambda i: _bytes(low[i], width) + (_bytes(high[i], 4) if width == 8 else b"")
            for k, x in enumerate((b, batch, hashes(one), _bytes(doc[one], 4), _bytes(pos[one], 4), hashes(lead), _bytes(doc[several], 4), _bytes(pos[several], 4))):
                rows[k].append(x)
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.table([pa.array(x, k) for x, k in zip(rows, kinds)], ["bucket", "batch", "once", "doc", "pos", "often", "sure_doc", "sure_pos"])


def _hashes(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if width < 8:
        low = _join_numbers(column, width)
        return low, np.zeros(len(low), dtype=np.uint64)
    parts = [(x[: len(x) * 2 // 3], x[len(x) * 2 // 3 :]) for x in column.to_pylist() if x]
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *(_numbers(a, 8) for a, _ in parts)]), np.concatenate([empty, *(_numbers(b, 4) for _, b in parts)])


def _meet(width: int):
    """For one bucket: the places of hashes that occur twice or more over all batches, by batch."""

    def run(table: pa.Table) -> pa.Table:
        batch = np.array(table.column("batch").to_pylist(), dtype=np.int64)
        sizes = np.array([len(x) // 4 for x in table.column("doc").to_pylist()], dtype=np.int64)
        low, high = _hashes(table.column("once"), width)
        often_low, often_high = _hashes(table.column("often"), width)
        every, every_high = np.concatenate((low, often_low)), np.concatenate((high, often_high))
        order = np.lexsort((every_high, every)) if width == 8 else np.argsort(every, kind="stable")
        every, every_high = every[order], every_high[order]
        same = (every[1:] == every[:-1]) & (every_high[1:] == every_high[:-1])
        twice = np.zeros(len(every), dtype=bool)
        twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        hit = twice[: len(low)]
        of = np.repeat(np.arange(len(sizes)), sizes)
        doc, pos = _join_numbers(table.column("doc"), 4), _join_numbers(table.column("pos"), 4)
        at = np.searchsorted(of[hit], np.arange(len(sizes) + 1))
        doc, pos = doc[hit], pos[hit]
        out: list[list] = [[], [], []]
        for k, (sure_doc, sure_pos) in enumerate(zip(table.column("sure_doc").to_pylist(), table.column("sure_pos").to_pylist())):
            d = np.concatenate((doc[at[k] : at[k + 1]], _numbers(sure_doc, 4)))
            if len(d):
                p = np.concatenate((pos[at[k] : at[k + 1]], _numbers(sure_pos, 4)))
                for column, x in zip(out, (int(batch[k]), _bytes(d, 4), _bytes(p, 4))):
                    column.append(x)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["batch", "doc", "pos"])

    return run


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = word_spans(texts)
    return _WORD.words(data, starts, ends), first


def _send_anchors(s: Shape):
    cover = np.zeros(s.period, dtype=bool)
    cover[list(COVERS[s.period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                words, first = _words(_unpack(row))
                counts = np.diff(first)
                doc = np.repeat(np.arange(len(counts)), counts)
                pos = np.arange(len(words)) - first[doc]
                # An anchor of a text shorter than a window can't lie in one.
                use = np.flatnonzero(cover[pos % s.period] & (pos + s.anchor <= counts[doc]) & (counts[doc] >= s.window))
                yield from _deal(row["batch"], _ANCHOR.spans(words, use, use + s.anchor), None, doc[use], pos[use], s.buckets, 6).to_batches()

    return run


def _send_windows(s: Shape):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        doc, pos = _join_numbers(right.column("doc"), 4).astype(np.int64), _join_numbers(right.column("pos"), 4).astype(np.int64)
        words, first = _words(_unpack(row)) if len(doc) else (np.zeros(0, dtype=np.uint64), np.zeros(2, dtype=np.int64))
        counts = np.diff(first)
        lo, hi = np.maximum(0, pos - (s.period - 1)), np.minimum(pos, counts[doc] - s.window) if len(doc) else pos
        mark = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(mark, first[doc] + lo, 1)
        np.add.at(mark, first[doc] + hi + 1, -1)
        at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        of = np.searchsorted(first, at, "right") - 1
        low, high = _LOW.spans(words, at, at + s.window), _HIGH.spans(words, at, at + s.window) & np.uint64(0xFFFFFFFF)
        return _deal(row["batch"], low, high, of, at - first[of], s.buckets, 8)

    return run


def _remove(s: Shape):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        texts = _unpack(row)
        doc, pos = _join_numbers(right.column("doc"), 4).astype(np.int64), _join_numbers(right.column("pos"), 4).astype(np.int64)
        by = np.argsort(doc, kind="stable")
        doc, pos = doc[by], pos[by]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        n_words, n_removed, kept = [], [], []
        for k, text in enumerate(texts):
            words = text.split()
            gone = 0
            if cuts[k] < cuts[k + 1]:
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                own = np.unique(pos[cuts[k] : cuts[k + 1]])
                np.add.at(mark, own, 1)
                np.add.at(mark, own + s.window, -1)
                stay = np.cumsum(mark)[:-1] == 0
                gone = len(words) - int(stay.sum())
                n_words.append(len(words))
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            else:
                n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(words).decode())
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, batch_bytes: int = 8 << 20, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = materialise(pack(docs, batch_bytes), "packed")
    # A bucket is held whole by a task: their number follows the text, about BATCHES_A_BUCKET batches of it for each.
    s = shape(window, buckets or max(LEAST_BUCKETS, -(-packed.count() // BATCHES_A_BUCKET)))
    near = materialise(packed.mapInArrow(_send_anchors(s), _SENT).groupBy("bucket").applyInArrow(_meet(6), _FOUND), "anchors")
    release(spark)
    sent = packed.groupBy("batch").cogroup(near.groupBy("batch")).applyInArrow(_send_windows(s), _SENT)
    found = materialise(sent.groupBy("bucket").applyInArrow(_meet(8), _FOUND), "windows")
    drop_materialised(near)
    release(spark)
    return packed.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_remove(s), "doc_id long, n_words long, n_removed long, kept string")
