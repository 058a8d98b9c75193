"""Sampled segmentations have the probabilities that they say, also without replacement."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import pieces, queries

N = 6000


def _drawn(text, k):
    vocabulary = pieces.load()
    out = []
    for rows in pieces.sample([text] * N, np.arange(1, N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), vocabulary, k):
        out += rows.to_pylist()
    return out


@pytest.mark.parametrize("text", ["the hat", "nation", "ab"])
def test_first_samples_follow_the_probabilities(text):
    drawn = _drawn(text, 3)
    assert len(drawn) == N
    p = {tuple(s["ids"]): np.exp(s["log_prob"]) for row in drawn for s in row}
    assert sum(p.values()) <= 1 + 1e-6
    firsts = {}
    for row in drawn:
        best = max(row, key=lambda s: s["perturbed"])
        firsts[tuple(best["ids"])] = firsts.get(tuple(best["ids"]), 0) + 1
        assert len({tuple(s["ids"]) for s in row}) == len(row)
    for ids, q in p.items():
        assert abs(firsts.get(ids, 0) - N * q) <= 4.5 * np.sqrt(N * q * (1 - q)) + 2, (ids, q, firsts.get(ids, 0))
    # Without replacement: the second is the first of what is left.
    seconds = {}
    for row in drawn:
        order = sorted(row, key=lambda s: -s["perturbed"])
        if len(order) > 1:
            key = tuple(order[1]["ids"])
            seconds[key] = seconds.get(key, 0) + 1
    for ids, q in p.items():
        want = sum(x * q / (1 - x) for other, x in p.items() if other != ids)
        if sum(p.values()) > 0.999 and want * N > 30:
            assert abs(seconds.get(ids, 0) - N * want) <= 5 * np.sqrt(N * want) + 3


def test_inclusion_scores_weigh_samples_back():
    """The sum of a figure over all segmentations is met on average by its samples, each over its inclusion score."""
    drawn = _drawn("the hat", 2)
    p = {tuple(s["ids"]): np.exp(s["log_prob"]) for row in drawn for s in row}
    sizes = [sum(np.exp(s["log_prob"]) / s["inclusion"] * len(s["ids"]) for s in row[:-1]) for row in _drawn("the hat", 4) if len(row) == 4]
    want = sum(q * len(ids) for ids, q in p.items())
    if sum(p.values()) > 0.995 and sizes:
        assert abs(np.mean(sizes) - want) < 0.25 * want


def test_probabilities_are_those_of_all_segmentations():
    """Of a short text all ways to cut it are drawn, and with their scores add up to 1."""
    drawn = _drawn("ab", 64)
    whole = {tuple(s["ids"]): s["log_prob"] for s in drawn[0]}
    assert abs(sum(np.exp(x) for x in whole.values()) - 1) < 1e-6 and all(s["inclusion"] == 1 for s in drawn[0])
    v = pieces.load()
    for a, b in itertools.combinations(whole, 2):
        assert abs((whole[a] - whole[b]) - (v.log_prob[list(a)].sum() - v.log_prob[list(b)].sum())) < 1e-6


def test_detokenise_without_ids_and_with_empty_lists():
    v = pieces.load()
    one = int(v.byte_ids[65])
    assert pieces.detokenise(np.zeros(0, dtype=np.int32), np.array([0, 0, 0]), v) == ["", ""]
    assert pieces.detokenise(np.array([one, one, one], dtype=np.int32), np.array([0, 0, 3]), v) == ["", "AA"]


def test_zero_characters_are_no_part_of_another_piece():
    v = pieces.load()
    texts = ["=\0", "\0", "a\0\0b", "0\0 -\0", "\0\0\0", "ab\0", "\u2581\0", "=\0" * 40]
    for seed in range(1, 20):
        keys = np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 * seed % (1 << 64))
        for samples in pieces.sample(texts, keys, v, 4):
            assert pieces.round_trips(samples, texts, v) == [True] * len(texts)
            # The space joins "=" or not; the byte stands alone.
            assert [len(s) for s in samples.to_pylist()][:2] == [2, 1]


def test_query_returns_the_pieces_themselves(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "=\0 \u2581 a\0"), (-4, "\U0010ffff \n")], "doc_id long, text string")
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_pieces(spark, str(tmp_path))
    got = pieces.decode(out, F.col("ids")).join(docs.union(odd), "doc_id").collect()
    assert len(got) == docs.count() + 4
    for r in got:
        assert r.decoded == [r.text or ""] * r.n_samples and r.round_trip
        assert r.n_pieces == [len(x) for x in r.ids] and len(r.perturbed) == len(r.inclusion) == len(r.log_prob) == r.n_samples
