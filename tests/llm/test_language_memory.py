"""What fitting the language model holds in the driver."""

import tracemalloc

import numpy as np

from halocline.llm import language_id


def test_fit_holds_dense_vectors_of_one_language_at_a_time(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1600):
        letters = "abcdefghijklmnopqrstuvwxyz"[i % 4 * 5 : i % 4 * 5 + 8]
        rows.append((i, f"l{i % 4}", " ".join("".join(rng.choice(list(letters), 5)) for _ in range(20))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs.count()
    tracemalloc.start()
    try:
        model = language_id.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    dense = 1600 * language_id.SIZE * 4
    assert model.languages == ["l0", "l1", "l2", "l3"] and len(model.centroids) == 16
    assert peak < 0.8 * dense
    assert language_id.predict([t for _, _, t in rows[:40]], model)[0] == [f"l{i % 4}" for i in range(40)]
