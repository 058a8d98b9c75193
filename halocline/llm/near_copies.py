"""Near copies by Jaccard similarity of word shingles: ball-hashed SimHash fingerprints find candidates, whole shingle sets decide.

A document's distinct shingles are one set, and documents with equal sets are one
node. A set has TABLES independent SimHash fingerprints of BITS bits: a bit is 1 if
over half of the shingles' hashes have it. Fingerprints within RADIUS bits are found by
meet-in-the-middle ball hashing as in ``simhash``: both emit all variants within half
the radius, and meet at a common one. Bits of two sets of similarity s and like size
differ with probability acos(2s / (1 + s)) / pi, so a pair at 0.8 is within the radius in
some fingerprint with probability 0.9998 (tests count it); sets of at most TINY
shingles, whose bits are noisier, have MOST_TABLES fingerprints.

Sharers of a variant are candidates where CHECK_BITS further bits are no further apart
than those of a link can be, five standard deviations included: this leaves out
sharers by chance. All pairs of sharers are looked at unless they are joined already. Sets
that candidates join in one place are a group, named by its least set. Groups that have a
set in common are one bucket, whatever their places and fingerprints: a set is in one
bucket only, so a pair is compared once, and no candidate pair is left out:

1. In each bucket all sets are compared with one centre, the set with the
   most neighbours over all its groups; what is linked gets a common label.
2. Buckets of three or more sets that still have several labels are compared in
   full, in blocks of bounded bytes: a group of tasks holds two blocks of a bucket
   and compares sets of different labels, until two labels are found linked. Sizes
   too far apart, and no shingle in common among each set's rarest (more than a link
   leaves unshared, so this is exact), rule pairs out without a comparison.

So a large group of near copies costs a few comparisons a set, whether or not a text
is in it that all are close to. Comparisons happen inside a task; rows come out for
links that join labels, never for pairs. Every link is checked on the full sets.

One 64-bit fingerprint within 4 bits does not reach 0.8: at 0.80 to 0.85 few pairs lie
that close (figures in the README). Many short ones do.

Text without words has the empty set, which equals other empty sets only. Null
text counts as empty. Null doc_id is allowed. Very long texts are whole sets; a block
holds one set at least. Rows that repeat doc_id and text are one document. Ties go to
the least id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, byte_list, connected_components, local_components, materialise, mixed, packed, release, same_document
from .simhash import shingle_hashes

TABLES, BITS, RADIUS = 28, 24, 2
#: Sets of so few shingles have more fingerprints.
TINY, MOST_TABLES = 5, 64
CHECK_BITS = 128
#: Places of a fingerprint hold so many sets that are not moved, about; and the least number of bits that choose a place.
PLACE_SETS, LEAST_SELECTOR = 1 << 16, 4
#: Fingerprints whose variants are shuffled at a time, and sets that a task deals to places at once.
ROUND_TABLES, DEAL_SETS = 8, 4000
#: Sharers of a variant that are compared together with those of other variants; more have a comparison of their own.
MANY = 64
#: Bytes of sets that a task compares with one centre, and that make a block of a bucket.
DEAL_BYTES = 8 << 20
#: Sets compared with one at a time.
CHUNK = 64
#: Shingles that one numpy pass works on.
BLOCK_SHINGLES = 1 << 16
_TABLE_BYTES, _CHECK_AT, _CHECK_BYTES = BITS // 8, TABLES * BITS // 8, CHECK_BITS // 8
_LENGTH, _MOST_LENGTH = _CHECK_AT + _CHECK_BYTES, _CHECK_AT + _CHECK_BYTES + (MOST_TABLES - TABLES) * BITS // 8
_RNG = np.random.default_rng(17)
_PLUS = _RNG.integers(0, 1 << 63, -(-_MOST_LENGTH // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: By byte: its bits as bytes of one number, so that sums of up to 255 of them count bits.
_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).view(np.uint64).reshape(-1)
#: What a place gets of a set: its name, fingerprint and check bits.
_MEMBER = np.dtype([("s", "<i8"), ("v", "<u4"), ("check", "<u8", CHECK_BITS // 64)])
_GROUP = "key long, s long"


def prints(sets: list[np.ndarray], length: int) -> np.ndarray:
    """(sets, length) bytes of SimHash bits of sets of shingle hashes, none of them empty: a bit is 1 if over half of the hashes have it."""
    out = np.empty((len(sets), length), dtype=np.uint8)
    sizes = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BLOCK_SHINGLES, "right")))
        joined, own = np.concatenate(sets[start:end]), sizes[start:end]
        # Parts of at most 255 shingles, none across sets.
        parts = -(-own // 255)
        of = np.repeat(np.arange(len(own)), parts)
        first = np.cumsum(parts) - parts
        begin = (np.cumsum(own) - own)[of] + 255 * (np.arange(len(of)) - first[of])
        for word in range(-(-length // 8)):
            raw = mixed(joined + _PLUS[word]).view(np.uint8).reshape(-1, 8)
            for byte in range(8 * word, min(8 * word + 8, length)):
                ones = np.add.reduceat(_SPREAD.take(raw[:, byte - 8 * word]), begin).view(np.uint8).reshape(-1, 8)
                ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
                out[start:end, byte] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little")[:, 0]
        start = end
    return out


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, _th (hash of the text), s (names the shingle set) and print (its SimHash bits; none for the empty set)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle_words)) for t in byte_list(batch.column("text"))]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            bits = [b""] * len(sets)
            for length, own in ((_LENGTH, [i for i, s in enumerate(sets) if len(s) > TINY]), (_MOST_LENGTH, [i for i, s in enumerate(sets) if 0 < len(s) <= TINY])):
                for i, row in zip(own, prints([sets[i] for i in own], length)):
                    bits[i] = row.tobytes()
            yield pa.record_batch([batch.column("doc_id"), batch.column("_th"), pa.array(names), pa.array(bits, pa.binary())], ["doc_id", "_th", "s", "print"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_th"), "text")
    return own.mapInArrow(run, "doc_id long, _th long, s long, print binary")


# ---- ball hashing


def _fingerprints(bits: np.ndarray, table: int) -> np.ndarray:
    """Fingerprint ``table`` of rows of ``prints``."""
    at = table * _TABLE_BYTES + (_CHECK_BYTES if table >= TABLES else 0)
    wide = np.zeros((len(bits), 4), dtype=np.uint8)
    wide[:, :_TABLE_BYTES] = bits[:, at : at + _TABLE_BYTES]
    return wide.view("<u4").reshape(-1)


def _selected(bits: int) -> np.ndarray:
    """``bits`` of a fingerprint's bits, dealt evenly."""
    return np.uint32(1) << ((np.arange(bits) * BITS) // bits).astype(np.uint32)


def dealt(names: np.ndarray, bits: np.ndarray, tables: range, selector: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (table and selector value) that variants of each of the fingerprints ``tables`` fall into, and who goes there."""
    mask, flips = np.bitwise_or.reduce(selector), np.concatenate((np.zeros(1, dtype=np.uint32), selector))
    for table in tables:
        rows = np.empty(len(names), dtype=_MEMBER)
        rows["s"], rows["v"] = names, _fingerprints(bits, table)
        rows["check"] = np.ascontiguousarray(bits[:, _CHECK_AT : _CHECK_AT + _CHECK_BYTES]).view("<u8")
        at = (rows["v"] & mask)[:, None] ^ flips[None, :]
        yield (at.reshape(-1).astype(np.int64) | table << BITS), np.repeat(rows, len(flips))


def joined_in_place(place: int, rows: np.ndarray, selector: np.ndarray, most: int) -> np.ndarray:
    """For each of the sets ``rows`` of one place, the least index that candidates lead to: pairs that share a variant and have check bits at most ``most`` apart."""
    n, mask = len(rows), np.bitwise_or.reduce(selector)
    v, check, at = rows["v"], rows["check"], np.uint32(place & ((1 << BITS) - 1))
    rest = np.uint32(1) << np.arange(BITS, dtype=np.uint32)
    tails = np.concatenate((np.zeros(1, dtype=np.uint32), rest[(rest & mask) == 0]))
    still = (v & mask) == at
    here, moved = np.flatnonzero(still), np.flatnonzero(~still)
    values = np.concatenate(((v[here][:, None] ^ tails[None, :]).reshape(-1), (v[moved] & ~mask) | at))
    owners = np.concatenate((np.repeat(here, len(tails)), moved))
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    edges = np.append(np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint32(1))), len(values))
    # Variants of one set only are done.
    size = np.diff(edges)
    keep = np.repeat(size > 1, size)
    owners, size = owners[keep], size[size > 1]
    end = np.repeat(np.cumsum(size), size)
    root, left = np.arange(n), np.arange(len(owners))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(check[a] ^ check[b]).sum(axis=-1, dtype=np.int64) <= most

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return local_components(np.concatenate((np.arange(n), a)), np.concatenate((root, b)), n) if len(a) else root

    for shift in range(1, MANY):
        left = left[left + shift < end[left]]
        if not len(left):
            break
        a, b = owners[left], owners[left + shift]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        ok = near(a, b)
        root = merge(a[ok], b[ok])
    for stop, m in zip(np.cumsum(size)[size > MANY].tolist(), size[size > MANY].tolist()):
        own = owners[stop - m : stop]
        parts, of, many = np.unique(root[own], return_inverse=True, return_counts=True)
        # Every set outside of the largest part with all sets of other parts.
        for x in own[of != many.argmax()].tolist() if len(parts) > 1 else []:
            others = own[root[own] != root[x]]
            others = others[near(others, np.full(len(others), x))]
            root = merge(np.full(len(others), x), others)
    return root


def groups(sets: DataFrame, count: int, least: float) -> DataFrame:
    """(key, s): sets by group, of ``sets`` (s, print), which are ``count`` distinct ones. A set is in one group at most for each place that it is dealt to."""
    selector = _selected(int(min(16, max(LEAST_SELECTOR, np.ceil(np.log2(max(count, 1) / PLACE_SETS))))))
    differ = float(np.arccos(2 * least / (1 + least)) / np.pi)
    most = int(np.ceil(CHECK_BITS * differ + 5 * np.sqrt(CHECK_BITS * differ * (1 - differ))))

    def deal(tables: range, length: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def rows() -> pa.RecordBatch:
                names, bits = (np.concatenate(x) for x in zip(*held))
                places, members = (np.concatenate(x) for x in zip(*dealt(names, bits, tables, selector)))
                order = np.argsort(places, kind="stable")
                places, members = places[order], members[order]
                cuts = np.append(np.flatnonzero(np.diff(places, prepend=-1)), len(places))
                held.clear()
                return pa.record_batch([pa.array(places[cuts[:-1]]), pa.array([members[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())], ["place", "members"])

            for batch in batches:
                if len(batch):
                    held.append((batch.column("s").to_numpy(), np.frombuffer(b"".join(batch.column("print").to_pylist()), dtype=np.uint8).reshape(-1, length)))
                if sum(len(x) for x, _ in held) >= DEAL_SETS:
                    yield rows()
            if held:
                yield rows()

        return run

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("members").to_pylist()), dtype=_MEMBER)
        rows = rows[np.argsort(rows["s"])]
        root = joined_in_place(key[0].as_py(), rows, selector, most)
        own = np.bincount(root, minlength=len(root))[root] > 1
        return pa.table({"key": rows["s"][root[own]], "s": rows["s"][own]})

    found = []
    tiny, other = sets.where(F.length("print") == _MOST_LENGTH), sets.where(F.length("print") == _LENGTH)
    for first in range(0, TABLES, ROUND_TABLES):
        tables = range(first, min(first + ROUND_TABLES, TABLES))
        sent = other.mapInArrow(deal(tables, _LENGTH), "place long, members binary").union(tiny.mapInArrow(deal(tables, _MOST_LENGTH), "place long, members binary"))
        found.append(materialise(sent.groupBy("place").applyInArrow(meet, _GROUP).distinct(), "groups"))
        release(sets.sparkSession)
    sent = tiny.mapInArrow(deal(range(TABLES, MOST_TABLES), _MOST_LENGTH), "place long, members binary")
    every = materialise(sent.groupBy("place").applyInArrow(meet, _GROUP).distinct(), "groups")
    for part in found:
        every = every.union(part)
    return every.distinct()


def buckets(rows: DataFrame) -> DataFrame:
    """(key, s, n): the one bucket of each set of ``groups``, and how many sets it has. Groups that share a set are one bucket, named by its least set."""
    # A large family is in many groups: each set keeps one edge, to the least of its groups, and each other group one to every such least.
    own = rows.withColumn("m", F.min("key").over(Window.partitionBy("s")))
    edges = own.select(F.col("m").alias("a"), F.explode(F.array("s", "key")).alias("b")).where("a <> b").distinct()
    found = materialise(connected_components(edges).select(F.col("component").alias("key"), F.col("node").alias("s")), "buckets")
    return found.join(found.groupBy("key").agg(F.count("*").alias("n")), "key")


def contents(docs: DataFrame, own: DataFrame, named: DataFrame, shingle_words: int) -> DataFrame:
    """s, size (bytes) and hashes (sorted, as bytes) of the sets that ``named`` has."""
    first = own.join(named, "s").groupBy("s").agg(F.min(F.struct("doc_id", "_th")).alias("r")).select("s", F.col("r.doc_id").alias("doc_id"), F.col("r._th").alias("_th"))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_th"), "text")
    # Rows that repeat doc_id and text are one document.
    rows = first.join(texts, same_document(first, texts)).select("s", "text").dropDuplicates(["s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle_words)).tobytes() for t in byte_list(batch.column("text"))]
            yield pa.record_batch([batch.column("s"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["s", "size", "hashes"])

    return rows.mapInArrow(run, "s long, size long, hashes binary")


def similarities(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of one sorted set with others, none of them empty."""
    joined = np.concatenate(others)
    sizes = np.array([len(y) for y in others])
    at = np.minimum(np.searchsorted(x, joined), len(x) - 1)
    both = np.add.reduceat((x[at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
    return both / (len(x) + sizes - both)


def prefixes(sets: list[np.ndarray], least: float) -> list[list[int]]:
    """Of each set the shingles that few sets have, so many of them that sets of similarity ``least`` have one of these in common; without those that no other set has among its own. Numbers stand for shingles."""
    sizes = np.array([len(x) for x in sets])
    _, of, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((of, many[of], owner))
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Sets with a link have least * size shingles in common, of which one is among the size - least * size + 1 that come first in any order of shingles.
    first = order[place < np.repeat(sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, sizes)]
    first = first[np.bincount(of[first], minlength=len(many))[of[first]] > 1]
    cuts = np.searchsorted(owner[first], np.arange(len(sets) + 1)).tolist()
    own = of[first].tolist()
    return [own[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def links_of(sets: list[np.ndarray], labels: list[int], blocks: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs (indexes) that join all labels among which there is a link. With two kinds of ``blocks`` only sets of different blocks are compared."""
    if not sets:
        return []
    across = len(set(blocks)) > 1
    sizes, block = np.array([len(x) for x in sets]), np.array(blocks)
    #: By label the one that it is joined to, and which labels those are joined of.
    top = {label: label for label in labels}
    joined = {label: [label] for label in labels}
    #: By shingle and label: the sets before that have it among their first ones.
    sharers: dict[int, dict[int, list[int]]] = {}
    found = []
    for x, shingles in enumerate(prefixes(sets, least)):
        mine = top[labels[x]]
        others: set[int] = set()
        for shingle in shingles:
            for label, own in sharers.get(shingle, {}).items():
                if top[label] != mine:
                    others.update(own)
        y = np.array(sorted(others), dtype=np.int64)
        near = (sizes[y] >= least * sizes[x]) & (sizes[x] >= least * sizes[y])
        if across:
            near &= block[y] != block[x]
        y = y[near]
        while len(y):
            part, y = y[:CHUNK], y[CHUNK:]
            hits = part[similarities(sets[x], [sets[k] for k in part.tolist()]) >= least].tolist()
            for k in hits:
                if (other := top[labels[k]]) != mine:
                    found.append((x, k))
                    mine, less = (mine, other) if len(joined[mine]) >= len(joined[other]) else (other, mine)
                    top.update(dict.fromkeys(joined[less], mine))
                    joined[mine] += joined.pop(less)
            if hits:
                y = y[np.array([top[labels[k]] != mine for k in y.tolist()], dtype=bool)]
        for shingle in shingles:
            by_label = sharers.setdefault(shingle, {})
            for label in [k for k in by_label if k != mine and top[k] == mine]:
                by_label.setdefault(mine, []).extend(by_label.pop(label))
            by_label.setdefault(mine, []).append(x)
    return found


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]


_LINK = "a long, b long"


def _star(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, sets, centre = table.column("s").to_numpy(), _sets(table), key[0].as_py()
        own = int(np.flatnonzero(names == centre)[0])
        linked = [k for at in range(0, len(sets), CHUNK) for k, s in zip(range(at, at + CHUNK), similarities(sets[own], sets[at : at + CHUNK])) if s >= least and k != own]
        return pa.table([pa.array([centre] * len(linked), pa.int64()), pa.array(names[linked], pa.int64())], ["a", "b"])

    return run


def _full(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("s", "ascending")])
        names = table.column("s").to_numpy()
        found = links_of(_sets(table), table.column("label").to_pylist(), table.column("block").to_pylist(), least)
        return pa.table([pa.array(names[[p[k] for p in found]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def components(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Sketches of ``docs``, and (s, component) of all sets that have a link to another: the least set that links lead to."""
    own = materialise(sketches(docs, shingle_words), "sketches")
    sets = materialise(own.where(F.length("print") > 0).groupBy("s").agg(F.first("print").alias("print")), "prints")
    rows = materialise(groups(sets, sets.count(), least), "groups")
    members = materialise(buckets(rows), "members")
    held = materialise(contents(docs, own, members.select("s"), shingle_words), "sets")

    weights = rows.join(rows.groupBy("key").agg(F.count("*").alias("w")), "key").groupBy("s").agg(F.sum("w").alias("w"))
    centres = members.join(weights, "s").groupBy("key").agg(F.max(F.struct("w", "s")).alias("m")).select("key", F.col("m.s").alias("c"))
    pairs = materialise(members.join(centres, "key").where("s <> c").select("c", "s").join(held.select("s", "size"), "s"), "pairs")
    deals = pairs.groupBy("c").agg(F.ceil(F.sum("size") / DEAL_BYTES).alias("_deals"))
    dealt = pairs.join(deals, "c").select("c", F.pmod(F.xxhash64("s"), F.col("_deals")).alias("deal"), "s")
    every = dealt.union(dealt.select("c", "deal", F.col("c").alias("s")).distinct())
    stars = every.join(held.select("s", "hashes"), "s").groupBy("c", "deal").applyInArrow(_star(least), _LINK)
    labels = materialise(connected_components(materialise(stars, "links")).withColumnRenamed("node", "s"), "labels")

    # A bucket of two has been compared in full.
    labelled = members.where("n > 2").join(labels, "s", "left").select("key", "s", F.coalesce("component", "s").alias("label")).join(held.select("s", "size"), "s")
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.sum("size") / DEAL_BYTES).alias("_n")).where("lo <> hi").select("key", "_n")
    blocks = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("s"), F.col("_n")))
    blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    blocks = blocks.select("key", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"), "s", "label", "block")
    full = materialise(blocks.join(held.select("s", "hashes"), "s").groupBy("key", "one", "two").applyInArrow(_full(least), _LINK), "links")
    if not full.take(1):
        return own, labels
    # The links of the second step join labels: components of labels, not of sets.
    named = lambda name: labels.select(F.col("s").alias(name), F.col("component").alias(f"_{name}"))
    joined = full.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = materialise(connected_components(joined), "merged")
    through = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("s", F.coalesce("_to", "component").alias("component"))
    alone = merged.withColumnRenamed("node", "s").join(labels.select("s"), "s", "left_anti").select("s", "component")
    return own, through.union(alone)


def one_of_each(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps one: that of its least non-null doc_id (ties: least hash of the text)."""
    own, parts = components(docs, shingle_words, least)
    found = own.select("doc_id", "_th", "s").join(parts, "s", "left").withColumn("component", F.coalesce("component", "s"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_th")).alias("_least"))
    stay = materialise(first.select(F.col("_least.doc_id").alias("_stay"), F.col("_least._th").alias("_stay_th")), "stay")
    texts = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    joined = texts.join(stay, texts["_id"].eqNullSafe(stay["_stay"]) & (texts["_th"] == stay["_stay_th"]), "left_semi")
    return joined.dropDuplicates(["_id", "_th"]).select("_row.*")
