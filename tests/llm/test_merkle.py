"""The Merkle manifest against hashing by hand, and the forest as a monoid."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from halocline.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, path):
    """Root of a list of digests; path[i] gets (left, right) of every level for leaf i."""
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in own[at + k]:
                    path[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            held.append([i for x in own[at : at + 8] for i in x])
        nodes, own = up, held
    return nodes[0]


def by_hand(rows):
    """rows of (doc_id, source, lang, n_chars, text): leaf, subroot, root and path of each."""
    leaves = [_leaf(*r) for r in rows]
    trees = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])):
        trees.setdefault(rows[i][2], []).append(i)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    path = [[] for _ in rows]
    tops = [[] for _ in names]
    subroots = []
    for name in names:
        own = [[] for _ in trees[name]]
        subroots.append(climb([leaves[i] for i in trees[name]], own))
        for i, p in zip(trees[name], own):
            path[i] += p
    root = climb(subroots, tops)
    for name, subroot, top in zip(names, subroots, tops):
        for i in trees[name]:
            path[i] += top
    of = {i: s for name, s in zip(names, subroots) for i in trees[name]}
    return leaves, of, root, path


ROWS = [
    *[(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(585)],
    *[(2000 + i, None, None, None, None) for i in range(9)],
    *[(3000 + i, "", "", 0, "") for i in range(8)],
    (None, "a", "fr", 3, "No Id"),
    (None, "a", "fr", 3, "No Id"),
    (7, "a", "fr", 3, "x" * 300000 + "Ü"),
    (7, "a", "fr", 3, "again"),
    (7, "a", "fr", 3, "again"),
    (9, "a", "lone", 1, "T"),
    *[(5000 + i, "b", f"l{i}", 1, "Many Trees") for i in range(70)],
]


def test_all_rows_against_hashing_by_hand(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string").repartition(7).withColumn("leaf", F.lit("own")).withColumn("a b", F.lit(1))
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    out = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf)
    got = sorted((str(tuple(r.x)), r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in out.select(F.struct("_row.doc_id", "_row.source", "_row.lang", "_row.n_chars", "_row.text", "_row.`a b`", "_row.leaf").alias("x"), "leaf", "subroot", "root", "path").collect())
    leaves, of, root, path = by_hand(ROWS)
    want = sorted((str((*r, 1, "own")), leaves[i], of[i], root, tuple(path[i])) for i, r in enumerate(ROWS))
    assert got == want
    assert max(len(r[4]) for r in got) == 4 + 3
    checked = out.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count()
    assert checked == len(ROWS)


def test_empty_table_and_one_row(spark):
    schema = "doc_id long, lang string"
    one = spark.createDataFrame([(None, None)], schema)
    leaf = merkle.digest(F.col("doc_id"), F.col("lang"))
    r = merkle.manifest(one, F.col("lang"), F.col("doc_id"), leaf).first()
    assert r.leaf == r.subroot == r.root == h("--") and r.path == []
    assert merkle.manifest(one.limit(0), F.col("lang"), F.col("doc_id"), leaf).count() == 0


def test_forests_merge_in_any_order_and_shape():
    rng = np.random.default_rng(4)
    for size in (1, 2, 8, 9, 64, 65, 130, 600):
        nodes = [("t", size, 0, i, h(str(i))) for i in range(size)]
        whole = merkle.Forest()
        for x in nodes:
            whole.add(*x)
        rng.shuffle(nodes)
        parts = []
        for at in range(0, size, 7):
            forest = merkle.Forest()
            for tree, n, level, i, value in nodes[at : at + 7]:
                forest.add(str(tree), int(n), int(level), int(i), str(value))
            parts.append(forest)
        rows = [r for p in parts for r in p.rows]
        while len(parts) > 1:
            a, b = parts.pop(int(rng.integers(len(parts)))), parts.pop(int(rng.integers(len(parts))))
            a.rows = []
            a.merge((tree, n, level, run, list(own), list(own.values())) for (tree, n, level, run), own in b.open.items())
            rows += a.rows
            parts.append(a)
        key = lambda r: (r[0], r[1], r[4], tuple(r[6]))
        assert sorted(map(key, rows)) == sorted(map(key, whole.rows)) and not parts[0].open and not whole.open


def test_query_notices_what_was_lower_cased(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    leaves, of, root, path = by_hand([tuple(r) for r in docs])
    got = {r.doc_id: r for r in queries.op12_merkle_manifest(spark, SMALL).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    noticed = 0
    for i, d in enumerate(docs):
        changed = d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and d.text != d.text.translate(lower)
        r = got[d.doc_id]
        assert (r.leaf, r.subroot, r.root) == (leaves[i], of[i], root)
        assert r.proof_sha256 == h(*(a + b for a, b in path[i])) and r.verified == (not changed)
        own = _leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text.translate(lower)) if changed else leaves[i]
        for a, b in path[i]:
            own = h(a, own, b)
        assert r.folded_root == own
        noticed += changed
    assert noticed > 20
