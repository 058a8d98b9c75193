"""Periodic runs against brute force over all periods."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from halocline.llm import periodic_runs, queries

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Start, length and smallest period of all maximal runs, from the definition."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            run = w[i : i + length]
            if j > i and length >= max(least, 2 * q) and not any(run[d:] == run[: length - d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = np.random.default_rng(5)
    for turn in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            w = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 70))).tolist()
            if turn % 2 and w:
                w = (w[: int(rng.integers(1, 20))] * 9)[: len(w)] + w[:3]
            texts.append(w)
        first = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
        least = int(rng.choice([2, 5, 12]))
        got = periodic_runs.find_runs(np.array(sum(texts, []), dtype=np.int64), first, least)
        assert list(zip(got.text, got.start, got.length, got.period)) == [(k, *r) for k, w in enumerate(texts) for r in brute(w, least)]


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    got = periodic_runs.find_runs(np.array(b), np.array([0, len(b)]), 2)
    assert list(zip(got.start, got.length, got.period)) == brute(b, 2)


def test_columns_nulls_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 10), (5, "x " * 30000), (5, "x " * 30000), (6, "p q r " * 3 + "z " + "k l m n " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("own")).withColumn("a b", F.lit(1))
    got = periodic_runs.runs_of(docs).select("_row.*", F.struct("n_words", "start", "length", "period", "runs", "collapsed").alias("r")).collect()
    by = {(r.doc_id, r.n_runs): tuple(r.r) for r in got}
    assert len(got) == len(rows) and by[1, "own"] == by[2, "own"] == by[3, "own"] == (0, None, None, None, "", "")
    assert by[None, "own"] == (20, 0, 20, 2, "0,20,2\n", "a b")
    assert by[5, "own"] == (30000, 0, 30000, 1, "0,30000,1\n", "x")
    assert by[6, "own"] == (30, 10, 20, 4, "10,20,4\n", "p q r p q r p q r z k l m n")
    assert periodic_runs.runs_of(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    planted = 0
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        w = WORDS.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        # Periods over 700 words are left to the random tests: brute force is quadratic.
        runs = brute(w) if n <= 1400 else None
        if runs is None:
            continue
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 10
