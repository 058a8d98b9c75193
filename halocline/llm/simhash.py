"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of both. Every distinct fingerprint therefore emits all variants within r
bits (2081 for r = 2), variants meet in a shuffle, and fingerprints that share a
variant are linked: each is within r bits of it, so the pair is within 2r bits,
and verification is a check of that distance.

A fingerprint's variants travel together: those that agree in the selector (some
bits dealt out evenly) go to one place as one row, and are written out there.
The number of selector bits follows the number of distinct fingerprints, so a
place holds a bounded share of them. Within a place, fingerprints that share a
variant form a star around the least one, never all pairs, and the stars are
merged to components before anything is shuffled again. Components over all
places are found by joins.

Text without words has fingerprint zero. Null text counts as empty. A row that
repeats doc_id and text is the same document. Null doc_id is allowed; a
component's id is its least non-null doc_id. An empty table gives an empty result.
Long texts are whole: their shingles are added up in blocks. A bit that half of the
hashes have is not set. Columns other than doc_id and text are not read by
``near_duplicates`` and stay as they are in ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_list, connected_components, local_components, lower_ascii, materialise, packed, word_spans

#: Distinct fingerprints that a place gets without flips, about.
PLACE_FINGERPRINTS = 1000
#: Variants that a task writes out at once.
MOST_VARIANTS = 4_000_000


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit is 1 if set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    set_ = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        # Counts of each byte value, times the bits of that value: adds up bits without unpacking every hash.
        for byte in range(8):
            set_[8 * byte : 8 * byte + 8] += np.bincount(part[:, byte], minlength=256) @ _BITS
    return sum(1 << i for i in np.flatnonzero(2 * set_ > len(hashes)).tolist())


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64, seed 42, of every run of ``size`` words joined by a space; of all words if there are fewer."""
    words = lower_ascii(text).split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= size:
        spans = [(0, len(joined))] if words else []
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id, _th (hash of the text) and fp, the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(shingle_hashes(t, shingle_words)) for t in byte_list(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("_th"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "_th", "fp"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_th"), "text")
    return own.mapInArrow(run, "doc_id long, _th long, fp long")


def selector_masks(bits: int) -> np.ndarray:
    """``bits`` positions dealt evenly over 64."""
    return np.uint64(1) << ((np.arange(bits) * 64) // max(bits, 1)).astype(np.uint64)


def _flips(masks: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 0..most, all ways to flip k of the masks, as one number each."""
    out = [np.zeros(1, dtype=np.uint64)]
    for k in range(1, most + 1):
        idx = np.array(_combinations(len(masks), k), dtype=np.int64).reshape(-1, k)
        out.append(np.bitwise_or.reduce(masks[idx], axis=1) if len(idx) else np.zeros(0, dtype=np.uint64))
    return out


def _combinations(n: int, k: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), k))


def ball_edges(prints: DataFrame, count: int, radius: int = 4) -> DataFrame:
    """(a, b): links that join all of the distinct ``prints`` (fp) at most ``radius`` bits apart; ``count`` is their number."""
    if radius % 2:
        # Sharers of a variant are within twice half the radius: for an odd radius some neighbours in a star would not be links.
        raise ValueError("radius must be even")
    half = radius // 2
    bits = int(min(24, max(1, np.ceil(np.log2(max(count, 1) / PLACE_FINGERPRINTS + 1)))))
    chosen = selector_masks(bits)
    rest = np.uint64(1) << np.arange(64, dtype=np.uint64)
    rest = rest[(rest & np.bitwise_or.reduce(chosen)) == 0]
    flips_in, flips_out = _flips(chosen, half), _flips(rest, half)
    selector = np.bitwise_or.reduce(chosen)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each selector value that some variant of the fingerprint has."""
        every = np.concatenate(flips_in)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            at = (fp & selector)[:, None] ^ every[None, :]
            yield pa.record_batch([pa.array(at.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(every)).view(np.int64))], ["at", "fp"])

    def variants(fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All variants with this selector value within ``half`` bits, and whose they are."""
        moved = np.bitwise_count((fp & selector) ^ at)
        values, owners = [], []
        for k in range(half + 1):
            own = np.flatnonzero(moved == k)
            if len(own):
                tails = np.concatenate(flips_out[: half - k + 1])
                values.append((((fp[own] & ~selector) | at[own])[:, None] ^ tails[None, :]).reshape(-1))
                owners.append(np.repeat(own, len(tails)))
        return np.concatenate(values), np.concatenate(owners)

    def star(fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of indexes: each sharer of a variant with the first sharer."""
        values, owners = variants(fp, at)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        same = np.flatnonzero(values[1:] == values[:-1])
        return owners[same], owners[same + 1]

    def meet(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy().view(np.uint64)
        fp = np.unique(table.column("fp").to_numpy().view(np.uint64))
        place = np.full(len(fp), at[0], dtype=np.uint64)
        # A crowded place is worked off by further bits of the variants, so that memory stays bounded.
        per = 1 + len(rest) + len(rest) * (len(rest) - 1) // 2
        parts = max(1, -(-len(fp) * per // MOST_VARIANTS))
        extra = int(np.ceil(np.log2(parts)))
        if extra == 0:
            a, b = star(fp, place)
        else:
            inner = rest[:: max(1, len(rest) // extra)][:extra]
            a, b = _split_star(fp, place, inner, selector, rest, half, radius)
        if extra == 0:
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[ok], b[ok]
        root = local_components(a, b, len(fp))
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    sent = prints.select("fp").mapInArrow(emit, "at long, fp long")
    return sent.groupBy("at").applyInArrow(meet, "a long, b long").distinct()


def _split_star(fp: np.ndarray, place: np.ndarray, inner: np.ndarray, selector: np.uint64, rest: np.ndarray, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``star``, one value of the ``inner`` bits at a time; merges after each so that the pairs kept are under one for each fingerprint."""
    mask = np.bitwise_or.reduce(inner)
    tails = [np.concatenate(_flips(rest[(rest & mask) == 0], half)[: k + 1]) for k in range(half + 1)]
    outer = np.bitwise_count((fp & selector) ^ place)
    root = np.arange(len(fp))
    for code in range(1 << len(inner)):
        want = np.bitwise_or.reduce(np.where((code >> np.arange(len(inner))) & 1, inner, np.uint64(0)))
        moved = outer + np.bitwise_count((fp & mask) ^ want)
        values, owners = [], []
        for k in range(half + 1):
            own = np.flatnonzero(moved == k)
            if len(own):
                values.append((((fp[own] & ~(selector | mask)) | place[own] | want)[:, None] ^ tails[half - k][None, :]).reshape(-1))
                owners.append(np.repeat(own, len(tails[half - k])))
        if values:
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            v, o = v[order], o[order]
            same = np.flatnonzero((v[1:] == v[:-1]) & (np.bitwise_count(fp[o[1:]] ^ fp[o[:-1]]) <= radius))
            merged = local_components(np.concatenate((np.arange(len(fp)), o[same])), np.concatenate((root, o[same + 1])), len(fp))
            root = merged
    moved_ = np.flatnonzero(root != np.arange(len(fp)))
    return moved_, root[moved_]


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, _th, fp, component (a fingerprint that names it) and component_id (least doc_id reachable by links of at most ``radius`` bits) of every row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = ball_edges(distinct.select("fp"), distinct.count(), radius)
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    # Links hold for fingerprints; the least doc_id of a component is a minimum over its fingerprints.
    own = distinct.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = own.select("fp", "component").join(ids, "component").select("fp", "component", "component_id")
    return prints.join(labels, "fp").select("doc_id", "_th", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of its least non-null doc_id (ties: least hash of the text)."""
    found = near_duplicates(docs, shingle_words, radius)
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_th")).alias("_least"))
    stay = materialise(least.select(F.col("_least.doc_id").alias("_stay"), F.col("_least._th").alias("_stay_th")), "stay")
    own = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    joined = own.join(stay, own["_id"].eqNullSafe(stay["_stay"]) & (own["_th"] == stay["_stay_th"]), "left_semi")
    # Rows that repeat doc_id and text are one document.
    return joined.dropDuplicates(["_id", "_th"]).select("_row.*")
