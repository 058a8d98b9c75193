"""The pipeline's near-duplicate stage against exact similarities, near its bound above all."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from halocline.llm import near_copies, simhash

RNG = np.random.default_rng(11)


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def _similarity(a, b):
    return len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b))


def _changed(words, n):
    out = list(words)
    for k in RNG.choice(len(out), n, replace=False):
        out[k] = f"new{int(RNG.integers(1 << 30))}"
    return " ".join(out)


def _prose(n):
    return [f"w{int(x)}" for x in RNG.integers(0, 4000, n)]


def test_stage_finds_pairs_from_0_8_on_and_no_others(spark):
    rows, want, between = [], {}, 0
    for i in range(600):
        words = _prose(300)
        other = _changed(words, int(RNG.integers(2, 11)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, other)]
        s = _similarity(" ".join(words), other)
        want[2 * i + 1] = s < 0.8
        between += 0.8 <= s < 0.9
    assert between > 150 and sum(want.values()) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert all(2 * i in stay for i in range(600))
    gone_short = [k for k, stays in want.items() if stays and k not in stay]
    missed = [k for k, stays in want.items() if not stays and k in stay]
    assert gone_short == [] and len(missed) <= 2
    # What the stage did before: one fingerprint within 4 bits.
    before = {r.doc_id for r in simhash.one_of_each(docs, shingle_words=5, radius=4).select("doc_id").collect()}
    assert sum(not stays and k in before for k, stays in want.items()) > 50


def test_large_group_around_one_text(spark):
    base = _prose(300)
    texts = [" ".join(base), *(_changed(base, 5) for _ in range(150))]
    assert min(_similarity(texts[0], t) for t in texts[1:]) >= 0.8
    assert np.mean([_similarity(a, b) >= 0.8 for a, b in combinations(texts[1:30], 2)]) < 0.2
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, " ".join(_prose(300)))]
    stay = {r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert stay == {0, 900}


def _groups(sets, least=0.8):
    """Least index that each set reaches by links, by brute force."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= least:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("across", [False, True])
def test_links_join_what_brute_force_joins(across):
    for turn in range(12):
        sets = []
        for _ in range(int(RNG.integers(1, 6))):
            base = RNG.integers(0, 1 << 40, int(RNG.integers(4, 120)), dtype=np.uint64)
            for _ in range(int(RNG.integers(1, 30))):
                own = base.copy()
                k = RNG.choice(len(own), int(RNG.integers(0, max(1, len(own) // 8) + 1)), replace=False)
                own[k] = RNG.integers(0, 1 << 40, len(k), dtype=np.uint64)
                sets.append(np.unique(own))
        sets = [sets[k] for k in RNG.permutation(len(sets))]
        n = len(sets)
        labels = list(range(n)) if turn % 2 else [int(x) for x in np.array(_groups(sets, 0.95))]
        links = []
        if across:
            block = [int(b) for b in RNG.integers(0, 3, n)]
            for one in range(3):
                for two in range(one, 3):
                    own = [k for k in range(n) if block[k] in (one, two)]
                    links += [(own[a], own[b]) for a, b in near_copies.links_of([sets[k] for k in own], [labels[k] for k in own], [block[k] for k in own], 0.8)]
        else:
            links = near_copies.links_of(sets, labels, [0] * n, 0.8)
        root = list(labels)
        for i, j in links:
            assert len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        assert root == _groups(sets)


@pytest.mark.parametrize("deal", [None, 30_000])
def test_families_without_their_original(spark, monkeypatch, deal):
    """Families of 2 to 200 copies of texts that are not there; with small blocks a bucket is compared by many tasks."""
    if deal:
        monkeypatch.setattr(near_copies, "DEAL_BYTES", deal)
    texts = []
    for size in (2, 3, 9, 20, 60, 60, 200):
        base = _prose(300)
        texts += [_changed(base, int(RNG.integers(3, 5))) for _ in range(size)]
    sets = [np.array(sorted(hash(x) & (1 << 62) - 1 for x in _shingles(t)), dtype=np.uint64) for t in texts]
    want = sorted(set(_groups(sets)))
    order = RNG.permutation(len(texts))
    docs = spark.createDataFrame([(int(k), texts[k]) for k in order], "doc_id long, text string")
    got = sorted(r.doc_id for r in near_copies.one_of_each(docs).select("doc_id").collect())
    assert got == want


def test_null_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (6, "a b c"), (None, "a b c"), (7, "x y z u v w"), (7, "x y z u v w"), (8, "x y z u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 4, 6, 7, 8]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def _found(sets, least=0.8):
    """(table, a, b) of candidates by ball hashing, a the least index of a place's group; and what brute force finds of pairs."""
    selector, names = near_copies._selected(near_copies.LEAST_SELECTOR), np.arange(len(sets))
    bits = near_copies.prints(sets, near_copies._MOST_LENGTH)
    got, want = set(), set()
    check = bits[:, near_copies._CHECK_AT : near_copies._CHECK_AT + near_copies._CHECK_BYTES]
    near = np.array([np.bitwise_count(check ^ row).sum(axis=1) <= 40 for row in check])
    for table in range(near_copies.MOST_TABLES):
        (places, rows), *_ = near_copies.dealt(names, bits, range(table, table + 1), selector)
        for place in np.unique(places).tolist():
            own = rows[places == place]
            own = own[np.argsort(own["s"])]
            root = near_copies.joined_in_place(place, own, selector, 40)
            got |= {(table, int(own["s"][a]), int(own["s"][b])) for b, a in enumerate(root) if a != b}
        v = near_copies._fingerprints(bits, table)
        a, b = np.nonzero((np.bitwise_count(v[:, None] ^ v[None, :]) <= near_copies.RADIUS) & near)
        want |= {(table, int(x), int(y)) for x, y in zip(a, b) if x < y}
    return got, want


def test_candidates_are_those_of_ball_hashed_fingerprints():
    """Pairs at 0.8, of sets from 5 to 300 shingles: all fingerprints within the radius meet, and nearly every pair has some."""
    for size, common in ((5, 4), (9, 8), (24, 20), (32, 28), (100, 84), (300, 260)):
        sets = []
        for _ in range(150):
            words = RNG.integers(0, 1 << 62, 2 * size, dtype=np.uint64)
            whole = size if size == 5 else size - (size - common) // 2 if size > 9 else size
            other = np.concatenate((words[:common], words[size : size + max(0, int(common / 0.8) - whole)]))
            sets += [np.unique(words[:whole]), np.unique(other)]
        got, want = _found(sets)
        assert got == want
        assert len({(a, b) for table, a, b in got if b == a + 1 and (size <= near_copies.TINY or table < near_copies.TABLES)}) >= 149


def test_many_sharers_of_one_variant():
    """Two families that share variants by chance: neither hides the other's links."""
    selector, n = near_copies._selected(near_copies.LEAST_SELECTOR), 2 * near_copies.MANY + 40
    rows = np.zeros(n, dtype=near_copies._MEMBER)
    rows["s"] = np.arange(n)
    rows["check"][1::2] = np.uint64((1 << 64) - 1)
    rows["check"][-1] = np.uint64(0x5555555555555555)
    root = near_copies.joined_in_place(0, rows, selector, 40)
    assert root.tolist() == [i % 2 for i in range(n - 1)] + [n - 1]


def test_family_in_many_groups_is_one_bucket(spark):
    """Each pair of a family of near copies is compared once, however many fingerprints bring it together."""
    bases = [_prose(60) for _ in range(2)]
    texts = [_changed(base, 3) for base in bases for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_copies.sketches(docs, 5).select("s", "print").distinct()
    rows = near_copies.groups(sets, sets.count(), 0.8).collect()
    found = near_copies.buckets(spark.createDataFrame(rows, "key long, s long")).collect()
    assert len(rows) > 5 * len(found)
    assert len({r.s for r in found}) == len(found) and {r.s for r in found} == {r.s for r in rows}
    root = {r.s: r.s for r in rows}
    for _ in rows:
        before = dict(root)
        for r in rows:
            root[r.s] = root[r.key] = min(root[r.s], root[r.key])
        if root == before:
            break
    assert {r.s: r.key for r in found} == root
    assert all(r.n == sum(x.key == r.key for x in found) for r in found)


def test_prefixes_of_linked_sets_meet():
    """At 0.8 exactly and over, for all small sizes; sets without a link are mostly ruled out."""
    for size in range(1, 41):
        for other in range(size, size * 5 // 4 + 1):
            for common in range(1, size + 1):
                if common * 5 >= (size + other - common) * 4:
                    words = RNG.choice(1 << 20, size + other - common, replace=False).astype(np.uint64)
                    noise = [np.unique(RNG.choice(words, min(len(words), 6))) for _ in range(8)]
                    sets = [np.sort(words[:size]), np.sort(np.concatenate((words[:common], words[size:]))), *noise]
                    first = near_copies.prefixes(sets, 0.8)
                    assert set(first[0]) & set(first[1]), (size, other, common)
