"""The attention model learns from all documents, not from the sample that it starts with."""

import numpy as np
from pyspark.sql import functions as F

from halocline.llm import lm_score

RNG = np.random.default_rng(23)


def _order(text):
    """Pairs of words apart by three others: a bigram does not see them."""
    out = []
    for _ in range(60):
        k = int(RNG.integers(0, 4))
        out += [f"{text[k]}", "x", "y", text[k + 4]]
    return " ".join(out)


def test_documents_outside_the_sample_take_part(spark):
    rows = [(i, _order("abcdefgh")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_o", F.xxhash64("doc_id"))
    first = docs.orderBy("_o").limit(8).select("doc_id").collect()
    sample = {r.doc_id for r in first}
    learn = F.col("doc_id") % 5 != 0
    n = lambda df: {r.doc_id: r.score for r in df.collect()}
    got = n(lm_score.score(docs.drop("_o"), learn, ~learn, sample_documents=8))
    alone = lm_score.train_on_all
    try:
        lm_score.train_on_all = lambda known, m, documents: m
        before = n(lm_score.score(docs.drop("_o"), learn, ~learn, sample_documents=8))
    finally:
        lm_score.train_on_all = alone
    held = [i for i in got if i % 5 == 0 and i not in sample]
    assert np.mean([got[i] for i in held]) > np.mean([before[i] for i in held]) + 1


def test_shards_do_not_follow_the_layout(spark):
    docs = spark.createDataFrame([(i, _order("abcdefgh")) for i in range(40)], "doc_id long, text string")
    learn = F.col("doc_id") >= 0
    a, b = ({r.doc_id: r.score for r in lm_score.score(docs.repartition(k), learn, ~learn).collect()} for k in (1, 7))
    assert all(abs(a[i] - b[i]) < 1e-3 for i in a)


def test_gradients_are_those_of_the_loss():
    m = lm_score.with_counts(lm_score.load_subwords(), np.array([5]), np.array([3]))
    texts = [b"one two three four five six seven eight nine ten eleven twelve"]
    lm_score.train(m, texts, steps=3, windows=2)
    stream, at = lm_score.Tokens(texts, m.subwords).streams()
    m.weights = {k: a.astype(np.float64) for k, a in m.weights.items()}
    for c, t in (lm_score._windows(stream, at)[:2], lm_score._whole_windows(stream, at)):
        _compare(m, stream[np.maximum(c, 0)], c >= 0, np.where(t >= 0, stream[np.maximum(t, 0)], -1))


def _compare(m, ids, real, targets):
    g = lm_score._gradients(m, ids, real, targets)
    loss = lambda: -lm_score.log_probs(m, ids, real, targets).sum() / (targets >= 0).sum()
    for k, a in m.weights.items():
        at_ = np.unravel_index(np.argmax(np.abs(g[k])), a.shape)
        keep = a[at_]
        a[at_] = keep + 1e-3
        up = loss()
        a[at_] = keep - 1e-3
        down = loss()
        a[at_] = keep
        assert abs((up - down) / 2e-3 - g[k][at_]) < 2e-2 * abs(g[k][at_]) + 1e-4, k
