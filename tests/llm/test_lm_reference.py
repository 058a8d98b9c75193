"""The language model's scores against plain causal attention, one subword at a time."""

import numpy as np

from halocline.llm import lm_score

RNG = np.random.default_rng(23)


def _model():
    s = lm_score.load_subwords()
    pairs = RNG.integers(0, s.size, 3000) * s.size + RNG.integers(0, len(s.ranks) + 1, 3000)
    m = lm_score.with_counts(s, np.unique(pairs), RNG.integers(1, 50, len(np.unique(pairs))))
    w = lm_score.WIDTH
    draw = lambda *shape: (RNG.standard_normal(shape) * 0.4).astype(np.float32)
    m.weights = {"embed": draw(s.size, w), "near": draw(lm_score.CONTEXT), **{k: draw(w, w) for k in "qkvox"}, "digit0": draw(1, w, s.shape[0]), "digit1": draw(s.shape[0], w, s.shape[1])}
    return m


def _plain(m, stream):
    """Sum over the subwords of one text; each looks back to the start of the half window before its own."""
    w = {k: a.astype(float) for k, a in m.weights.items()}
    total = 0.0
    for i in range(len(stream) - 1):
        first = max(0, (i // lm_score.HALF - 1) * lm_score.HALF)
        own = w["embed"][stream[i]]
        logits = np.array([(own @ w["q"]) @ (w["embed"][stream[j]] @ w["k"]) / lm_score.WIDTH**0.5 + w["near"][i - j] for j in range(first, i + 1)])
        share = np.exp(logits - logits.max())
        share /= share.sum()
        seen = sum(a * (w["embed"][stream[j]] @ w["v"]) for a, j in zip(share, range(first, i + 1)))
        h = np.tanh(seen @ w["o"] + own @ w["x"])
        group, place = divmod(int(stream[i + 1]), m.subwords.shape[1])
        for z, right in ((m.biases[0][0, stream[i]] + h @ w["digit0"][0], group), (m.biases[1][group, stream[i]] + h @ w["digit1"][group], place)):
            z = z.astype(float)
            total += z[right] - z.max() - np.log(np.exp(z - z.max()).sum())
    return total


def test_scores_are_those_of_one_subword_at_a_time():
    m = _model()
    words = ["the", "river", "Ünïcode", "x" * 40, "of", "12345", "ab"]
    texts = [b"", b"a", *(" ".join(RNG.choice(words, int(n))).encode() for n in RNG.integers(1, 60, 12)), " ".join(words * 40).encode()]
    stream, at = lm_score.Tokens(texts, m.subwords).streams()
    got = lm_score.score_streams(m, stream, at)
    want = [_plain(m, stream[a:b]) for a, b in zip(at[:-1], at[1:])]
    np.testing.assert_allclose(got, want, rtol=2e-4)


def test_probabilities_of_all_next_subwords_add_up_to_one():
    m = _model()
    ids = RNG.integers(0, len(m.subwords.ranks) + 1, (1, lm_score.CONTEXT))
    real = np.ones_like(ids, dtype=bool)
    every = np.arange(m.subwords.size)
    p = 0.0
    for a in range(0, len(every), 256):
        own = every[a : a + 256]
        targets = np.full((len(own), lm_score.HALF), -1)
        targets[:, -1] = own
        p += np.exp(lm_score.log_probs(m, np.repeat(ids, len(own), axis=0), np.repeat(real, len(own), axis=0), targets)[:, -1]).sum()
    assert abs(p - 1) < 1e-3
