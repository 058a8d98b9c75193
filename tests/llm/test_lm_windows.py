"""Windows of the same subwords run through the language model once and count for each text that has them."""

import numpy as np

from halocline.llm import lm_score


def _trained():
    s = lm_score.load_subwords()
    m = lm_score.with_counts(s, np.array([5]), np.array([3]))
    return lm_score.train(m, [b"one two three four five six seven eight nine ten eleven twelve"], steps=3, windows=2)


def test_equal_windows_run_once(monkeypatch):
    m, plain, seen = _trained(), lm_score.log_probs, []
    line = b"the same line of a page, as long as a few windows of subwords are, and then some more of it"
    texts = [line, b"another text", line, b"", line + b" with an end of its own", line, b""]
    scores = lambda own: lm_score.score_streams(m, *lm_score.Tokens(own, m.subwords).streams())
    alone = [scores([t])[0] for t in texts]
    monkeypatch.setattr(lm_score, "log_probs", lambda m, ids, *rest: seen.append(len(ids)) or plain(m, ids, *rest))
    once = scores([line, b"another text", b"", line + b" with an end of its own"])
    n, seen[:] = sum(seen), []
    got = scores(texts)
    assert sum(seen) == n
    np.testing.assert_allclose(got, alone, rtol=1e-6)
    np.testing.assert_allclose(got[[0, 1, 3, 4]], once, rtol=1e-6)


def test_one_subword_makes_another_window():
    m = _trained()
    texts = [b"a" * 40 + b" b " + b"c" * 40, b"a" * 40 + b" d " + b"c" * 40, b"a" * 40 + b" b " + b"c" * 39, b"b", b"", b"d"]
    stream, at = lm_score.Tokens(texts, m.subwords).streams()
    got = lm_score.score_streams(m, stream, at)
    for i in range(len(texts)):
        own = stream[at[i] : at[i + 1]]
        np.testing.assert_allclose(got[i], lm_score.score_streams(m, own, np.array([0, len(own)]))[0], rtol=1e-6)


def test_attention_logits_over_the_bound_stay_finite():
    m = _trained()
    m.weights["q"], m.weights["k"] = m.weights["q"] * 300, m.weights["k"] * 300
    stream, at = lm_score.Tokens([b"one two three four five six"], m.subwords).streams()
    assert np.isfinite(lm_score.score_streams(m, stream, at)).all()


def test_weights_of_the_optimiser_are_those_of_the_model():
    m = _trained()
    before = {k: a.copy() for k, a in m.weights.items()}
    lm_score.Adam(m.weights).update({k: np.ones_like(a) for k, a in m.weights.items()}, 0.01)
    for k, a in m.weights.items():
        # The first step of Adam is the rate, whatever the gradient's size.
        np.testing.assert_allclose(a, np.clip(before[k] - 0.01, -4, 4) if k.startswith("digit") else before[k] - 0.01, atol=1e-5)
