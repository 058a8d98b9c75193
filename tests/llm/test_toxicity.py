"""Toxicity: the label model on votes of known origin, held-out accuracy, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import queries, toxicity
from halocline.llm.common import remainder

MIDDLE = "/root/testdata/sf0.1"


def _votes(rng, n):
    """Texts, a tenth toxic: three voters that fire apart, and one with two that repeat it nearly always."""
    y = rng.random(n) < 0.1
    fired = np.zeros((n, len(toxicity.VOTERS)), dtype=np.int64)
    for j, (hit, miss) in {12: (0.7, 0.02), 13: (0.6, 0.03), 14: (0.5, 0.01), 0: (0.6, 0.15)}.items():
        fired[:, j] = rng.random(n) < np.where(y, hit, miss)
    for j in (3, 6):
        fired[:, j] = np.where(rng.random(n) < 0.98, fired[:, 0], 1 - fired[:, 0])
    return y, fired @ (1 << np.arange(len(toxicity.VOTERS), dtype=np.int64))


@pytest.mark.parametrize("share", [0.3, 0.0])
def test_label_model_finds_accuracies_and_does_not_count_copies_twice(spark, share):
    rng = np.random.default_rng(1)
    y, votes = _votes(rng, 40000)
    label = np.where(rng.random(len(y)) < share, y.astype(int), -1)
    rows = spark.createDataFrame([(int(v), int(l)) for v, l in zip(votes, label)], "votes long, label int").groupBy("votes", "label").agg(F.count("*").alias("n"))
    model, pairs = toxicity.fit_labels(rows, 12)
    if share:
        assert abs(model.prior - 0.1) < 0.02
    p = model.posterior(votes, np.full(len(y), -1))
    if share:
        # Calibrated: of texts with a posterior near p a share of p is toxic. Independent voters would be far off where the copies fire.
        for lo in (0.0, 0.1, 0.3, 0.6, 0.9):
            own = (p >= lo) & (p < lo + 0.3)
            assert own.sum() < 300 or abs(p[own].mean() - y[own].mean()) < 0.06
        found = model.accuracies(pairs)
        for j in (12, 13, 14, 0):
            fires = votes >> j & 1 == 1
            assert abs(found[toxicity.VOTERS[j]] - y[fires].mean()) < 0.05
        # The copies hang on the voter that they repeat, or on each other.
        linked = {frozenset((j, int(model.parent[j]))) for j in (0, 3, 6) if model.parent[j] in (0, 3, 6)}
        assert len(linked) == 2
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.85


def test_voters_of_plain_texts():
    known = toxicity.chosen_features([])
    names = lambda t: {v for v, f in zip(toxicity.VOTERS, toxicity.unpack(toxicity.look([t], known).votes)[0]) if f}
    assert {"insults", "contempt", "address"} <= names("Are you an IDIOT, pathetic?")
    assert "respelled" in names("what an 1d1ot") and "masked" in names("sh*t happens")
    assert {"shouting", "marks"} <= names("STOP THIS NOW OR ELSE, ALL OF THEM!!!")
    assert names("The river runs by the town.") == {"no hit", "nothing at all", "calm"}
    assert names("Der Abschaum") >= {"german"} and "no hit" not in names("connard")


def test_words_and_their_beginnings():
    words = toxicity.words_of(["Über-schäumend", "", "schäumend ab1cd"])
    assert words.first.tolist() == [0, 2, 2, 5]
    assert words.hashes[0][0][1] == words.hashes[0][0][2]
    # Beginnings of words that are longer: four letters of "über" are no beginning, of "schäumend" they are.
    assert words.hashes[4][1].tolist() == [1, 2] and words.hashes[6][1].tolist() == [1, 2]
    assert toxicity.words_of(["schäxyz"]).hashes[4][0][0] == words.hashes[4][0][0]


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = queries.op11_toxicity(spark, MIDDLE).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    toxic, clean = [r.predicted for r in held if r.toxic == 1], [r.predicted for r in held if r.toxic == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_labels_of_held_out_documents_change_nothing(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic")
    learn = remainder(F.col("doc_id"), 4) != 2
    turned = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.fit(docs, x, learn) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.base == b.base


def test_odd_tables(spark):
    schema, names = "doc_id long, text string", ["score", "_row", "a b"]
    rows = [(1, None), (2, ""), (None, "you idiot"), (None, "you idiot"), (3, "x " * 200000 + "moron"), (3, "plain"), (4, "A river runs by. " * 5)]
    docs = spark.createDataFrame(rows, schema)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    for own, known in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels.limit(0)), (docs.limit(0), labels)):
        model = toxicity.fit(own, known)
        out = toxicity.score(docs, model)
        assert out.columns == ["_row", "score", "predicted"] and out.select("_row.*").columns == docs.columns
        got = out.select("_row.doc_id", "_row.text", "score").collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
