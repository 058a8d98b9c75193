"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier.

Voters are lexicons and patterns. Some lexicons are fixed lists by theme and language;
others are induced: words and word beginnings that labelled toxic texts have far more
often than labelled clean ones, dealt to voters by kind and strength. Patterns look at
address, shouting, masked and respelled words, rows of marks and density. Each voter
fires or not, and has a side that it votes for.

The label model is generative: y is toxic or not, a label agrees with y at some rate,
and each vote depends on y and on one other vote, its parent in the tree that keeps
the most of what votes tell about each other when y is known. So votes that stem from
the same word count once and not four times. It is fitted by expectation and
maximisation over the counts of distinct votes of all documents that may be learned
from, with labels where there are any; a round adds up counts of pairs of votes in
Spark, and the driver gets a number for each pair of voters.

The linear classifier is a logistic regression on the features' presence, trained on
the label model's posteriors of a bounded sample (``per_class`` labelled documents of
either class, ``unlabelled`` others, those of the least hashes). Two passes read all
texts: one for the votes to learn from, one for the scores.

Null text counts as empty; empty texts get the score of no feature. A null doc_id has
no label. Of several labels of one doc_id the highest counts; null labels are none.
Repeated rows are rows like others, though a text counts once where the lexicons are
induced. Without labels the fixed lists remain, without documents scores still lie in
0 to 1. Texts are whole, whatever their length. Users' columns travel in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Rolling, bounded_batches, materialise, mixed, packed, word_spans

#: Insults and threats by theme and language.
LEXICONS = {
    "insults": "idiot idiots moron morons imbecile cretin dumbass stupid dumb fool fools clown clowns jerk retard",
    "contempt": "loser losers pathetic worthless useless coward pig parasite vermin cockroach",
    "filth": "scum trash garbage filth filthy disgusting vile scumbag dirtbag",
    "threats": "kill murder strangle hang rape bomb shoot stab die",
    "profanity": "fuck fucking fucker shit bullshit bitch bastard asshole cunt dick whore slut",
    "german": "idiot idioten trottel depp dumm dummkopf arschloch scheisse scheiße abschaum hurensohn versager wichser",
    "french": "idiot idiote imbécile connard connasse salaud ordure débile merde pute abruti crétin",
    "spanish": "idiota imbécil estúpido estúpida basura escoria mierda puta cabrón pendejo inútil asqueroso",
}
ADDRESS = "you your youre yourself u ur du dich dir ihr euch tu toi te vous tú usted ustedes ti"
#: What characters stand for in respelled words.
_RESPELLED = str.maketrans("013457@$!", "oieastasi")

_NO_LETTERS = re.compile(r"[\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]+[*@$#]+[^\W\d_]+\b")
_RESPELL = re.compile(r"[^\W_]*(?:[^\W\d_][013457@$!]|[013457@$!][^\W\d_])[\w@$!]*")
_MARKS = re.compile(r"[!?]{3,}")

#: Lengths of word beginnings; 0 is the whole word.
KINDS = (0, 4, 5, 6)
#: Odds of a feature in toxic texts against clean ones, by strength.
STRENGTHS = (40.0, 8.0, 3.0)
MOST_TOXIC, MOST_CLEAN = 3072, 1024
LEAST_TEXTS = 3
#: Standard errors between the shares of a feature in toxic and clean texts: there are up to millions of features to choose from.
LEAST_Z = 5.0
#: What a text without a label counts in the first round, when there are labels to start from.
FIRST_SHARE = 0.02

_HASH = Rolling(11)
_SALT = {k: mixed(np.array([k + 1], dtype=np.uint64))[0] for k in KINDS}
_PATTERNS = ["several", "address", "shouting", "masked", "respelled", "marks", "dense", "no hit", "nothing at all", "calm"]
_CLEAN = {"no hit", "nothing at all", "calm"}
VOTERS = [f"induced {k or 'word'} {s:g}" for k in KINDS for s in STRENGTHS] + list(LEXICONS) + _PATTERNS
#: Voters for toxic are 1, for clean -1.
SIDES = np.array([-1 if v in _CLEAN else 1 for v in VOTERS])
_FIRST_LEXICON = len(KINDS) * len(STRENGTHS)
_FIRST_PATTERN = _FIRST_LEXICON + len(LEXICONS)


class Words(NamedTuple):
    """Words of a batch: number of words before each text (one more at the end), and hashes by kind with the word that each belongs to."""

    first: np.ndarray
    hashes: dict[int, tuple[np.ndarray, np.ndarray]]


def words_of(texts: list[str]) -> Words:
    """Lower-case words of letters, and their beginnings where the word is longer."""
    data, starts, ends, first = word_spans([_NO_LETTERS.sub(" ", t.lower()).encode() for t in texts])
    found: dict[int, list] = {k: [] for k in KINDS}
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        lo, hi = starts[i], ends[j - 1]
        own, a, b = data[lo:hi], starts[i:j] - lo, ends[i:j] - lo
        sums = _HASH.sums(_HASH.table[own])
        lead = (own & 0xC0) != 0x80
        place, number = np.append(np.flatnonzero(lead), len(own)), np.cumsum(lead) - 1
        at = number[a]
        size = np.append(number, number[-1] + 1)[b - 1] - at + 1
        for k in KINDS:
            longer = np.flatnonzero(size > k) if k else np.arange(len(a))
            end = place[at[longer] + k] if k else b
            found[k].append((_HASH.between(sums, a[longer], end) ^ _SALT[k], longer + i))
        i = j
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    return Words(first, {k: tuple(np.concatenate(x) for x in zip(*v)) if v else none for k, v in found.items()})


def hash_words(text: str) -> np.ndarray:
    return np.unique(words_of([text]).hashes[0][0])


class Features(NamedTuple):
    """Hashes in order; a code for each: induced voter, or -1; bits of fixed lexicons."""

    hashes: np.ndarray
    voter: np.ndarray
    lexicons: np.ndarray


def fixed_features() -> dict[int, int]:
    """Hash of each word of the fixed lexicons to the bits of those that have it."""
    bits: dict[int, int] = {}
    for k, words in enumerate(LEXICONS.values()):
        for h in hash_words(words).tolist():
            bits[h] = bits.get(h, 0) | 1 << k
    return bits


def chosen_features(induced: list[tuple[int, int, float]]) -> Features:
    """``induced`` has the hash, kind and odds of toxic against clean."""
    fixed = fixed_features()
    voters = {}
    for h, kind, odds in induced:
        strength = next((n for n, s in enumerate(STRENGTHS) if odds >= s), None)
        voters[h] = -1 if strength is None else KINDS.index(kind) * len(STRENGTHS) + strength
    hashes = np.array(sorted({*voters, *fixed}), dtype=np.uint64)
    return Features(hashes, np.array([voters.get(h, -1) for h in hashes.tolist()], dtype=np.int64), np.array([fixed.get(h, 0) for h in hashes.tolist()], dtype=np.int64))


class Found(NamedTuple):
    """Distinct (text, feature) by text, cuts of the texts in them, and the votes as bits of one number for each text."""

    feature: np.ndarray
    cuts: np.ndarray
    votes: np.ndarray


def look(texts: list[str], known: Features) -> Found:
    """Features and votes of texts."""
    words, n = words_of(texts), len(texts)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(known.hashes >> np.uint64(48)).astype(np.int64)] = True
    features, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for h, word in words.hashes.values():
        some = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)]) if len(known.hashes) else at[0]
        where = np.minimum(np.searchsorted(known.hashes, h[some]), max(len(known.hashes) - 1, 0))
        hit = known.hashes[where] == h[some] if len(some) else some.astype(bool)
        features.append(where[hit])
        at.append(word[some[hit]])
    feature, word = np.concatenate(features), np.concatenate(at)
    text = np.searchsorted(words.first, word, "right") - 1
    fired = np.zeros((n, len(VOTERS)), dtype=bool)
    voter = known.voter[feature]
    fired[text[voter >= 0], voter[voter >= 0]] = True
    for k in range(len(LEXICONS)):
        fired[text[known.lexicons[feature] >> k & 1 == 1], _FIRST_LEXICON + k] = True
    # Words that a fixed list or an induced one of the two upper strengths has.
    hit = (known.lexicons[feature] > 0) | ((voter >= 0) & (voter % len(STRENGTHS) < 2))
    hit_words = np.unique(word[hit])
    hits = np.bincount(np.searchsorted(words.first, hit_words, "right") - 1, minlength=n)
    length = np.diff(words.first)
    pattern = fired[:, _FIRST_PATTERN:]
    pattern[:, 0] = hits >= 3
    you = np.flatnonzero(np.isin(words.hashes[0][0], hash_words(ADDRESS)))
    near = np.searchsorted(you, hit_words)
    close = np.zeros(len(hit_words), dtype=bool)
    if len(you):
        for other in (you[np.minimum(near, len(you) - 1)], you[np.maximum(near - 1, 0)]):
            close |= (np.abs(other - hit_words) <= 3) & (np.searchsorted(words.first, other, "right") == np.searchsorted(words.first, hit_words, "right"))
    pattern[np.searchsorted(words.first, hit_words[close], "right") - 1, 1] = True
    fixed = known.hashes[known.lexicons > 0]
    for i, t in enumerate(texts):
        plain = t.encode()
        letters = np.frombuffer(plain, dtype=np.uint8)
        upper, lower = int(((letters >= 65) & (letters <= 90)).sum()), int(((letters >= 97) & (letters <= 122)).sum())
        marks = plain.count(b"!")
        pattern[i, 2] = upper > lower and upper >= 20 and marks >= 3
        pattern[i, 5] = marks > 0 and bool(_MARKS.search(t))
        pattern[i, 9] = marks == 0 and 3 * upper < lower
        if any(c in t for c in "*@$#") and _MASKED.search(t):
            pattern[i, 3] = True
        respelled = _RESPELL.findall(t.lower()) if marks or any(c in t for c in "013457@$") else []
        if respelled:
            pattern[i, 4] = bool(np.isin(words_of([" ".join(w.rstrip("!").translate(_RESPELLED) for w in respelled)]).hashes[0][0], fixed).any())
    pattern[:, 6] = hits * 100 >= np.maximum(length, 1)
    pattern[:, 7] = hits == 0
    pattern[:, 8] = ~fired[:, :_FIRST_PATTERN].any(axis=1)
    pairs = np.unique(text * max(len(known.hashes), 1) + feature)
    of = pairs // max(len(known.hashes), 1)
    return Found(pairs % max(len(known.hashes), 1), np.searchsorted(of, np.arange(n + 1)), fired @ (1 << np.arange(len(VOTERS), dtype=np.int64)))


# ---- the label model


class LabelModel(NamedTuple):
    """prior of toxic; how often a label is y; parent of each voter (-1: none); p[y, j, b]: rate at which voter j fires, given y and b, its parent's vote."""

    prior: float
    label_rate: float
    parent: np.ndarray
    rate: np.ndarray

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of toxic for votes (bits) and labels (-1: none)."""
        fired = unpack(votes)
        of = np.where(self.parent >= 0, fired[:, np.maximum(self.parent, 0)], 0)
        logs = []
        for y in (0, 1):
            p = np.where(of == 1, self.rate[y, :, 1], self.rate[y, :, 0])
            logs.append(np.log(np.where(fired == 1, p, 1 - p)).sum(axis=1) + np.log(self.prior if y else 1 - self.prior) + np.where(label < 0, 0.0, np.log(np.where(label == y, self.label_rate, 1 - self.label_rate))))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def accuracies(self, pairs: np.ndarray) -> dict[str, float]:
        """Share of each voter's votes that are right, from the sums of the last round."""
        own = pairs[:, np.arange(len(VOTERS)), np.arange(len(VOTERS))]
        right = np.where(SIDES > 0, own[1], own[0])
        return dict(zip(VOTERS, (right / np.maximum(own.sum(axis=0), 1e-9)).round(4).tolist()))


def unpack(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.int8)


def first_posterior(votes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels, and where there are none the side of the voters that aren't weak."""
    fired = unpack(votes)
    weak = np.array([v.endswith(f" {STRENGTHS[-1]:g}") or v in ("calm", "marks", "shouting", "masked") for v in VOTERS])
    against = fired[:, VOTERS.index("no hit")] == 1
    guess = np.where(against, 0.02, np.where((fired * (SIDES > 0) * ~weak).sum(axis=1) >= 2, 0.9, 0.3))
    return np.where(label < 0, guess, np.where(label == 1, 0.99, 0.01))


def maximised(pairs: np.ndarray, total: np.ndarray, labels: np.ndarray) -> LabelModel:
    """From expected counts: pairs[y, j, k] of two voters that both fire, total[y], labels[y, l]."""
    k = len(VOTERS)
    fires = pairs[:, np.arange(k), np.arange(k)]
    n = total[:, None, None] + 1e-9
    both = pairs
    j_only, k_only = fires[:, :, None] - pairs, fires[:, None, :] - pairs
    none = n - both - j_only - k_only
    told = np.zeros((k, k))
    p = fires / (total[:, None] + 1e-9)
    for cell, a, b in ((both, p[:, :, None], p[:, None, :]), (j_only, p[:, :, None], 1 - p[:, None, :]), (k_only, 1 - p[:, :, None], p[:, None, :]), (none, 1 - p[:, :, None], 1 - p[:, None, :])):
        cell = np.maximum(cell, 0)
        told += (cell * np.log(np.maximum(cell / n, 1e-12) / np.maximum(a * b, 1e-12))).sum(axis=0)
    np.fill_diagonal(told, -np.inf)
    # The tree that keeps most: from one voter on, the voter next to the tree that it tells most about.
    parent, inside = np.full(k, -1), np.zeros(k, dtype=bool)
    inside[0] = True
    for _ in range(k - 1):
        open_ = np.where(inside[:, None] & ~inside[None, :], told, -np.inf)
        a, b = divmod(int(np.argmax(open_)), k)
        parent[b], inside[b] = a, True
    own = np.arange(k)
    up = np.maximum(parent, 0)
    with_, of = pairs[:, own, up], fires[:, up]
    alone = fires + 0.5, total[:, None] + 1.0
    given = np.stack([(fires - with_ + 0.5) / (total[:, None] - of + 1.0), (with_ + 0.5) / (of + 1.0)], axis=2)
    rate = np.where((parent < 0)[None, :, None], (alone[0] / alone[1])[:, :, None], given)
    seen = labels.sum()
    agreed = (labels[0, 0] + labels[1, 1] + 20) / (seen + 20.5)
    return LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 10), 1e-4, 0.5)), float(np.clip(agreed, 0.9, 0.999)), parent, np.clip(rate, 1e-4, 1 - 1e-4))


def _expected(model: LabelModel | None, share: float):
    """Rows (cell, value) that add up to the expected counts: pairs, totals, labels by y. A text without a label counts ``share``."""
    k = len(VOTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * k * k + 2 + 4)
        for batch in batches:
            votes, label, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("votes", "label", "n"))
            toxic = model.posterior(votes, label) if model else first_posterior(votes, label)
            n = np.where(label < 0, share * n, n)
            fired = unpack(votes).astype(float)
            for y, r in enumerate((n * (1 - toxic), n * toxic)):
                sums[y * k * k : (y + 1) * k * k] += (fired.T @ (fired * r[:, None])).reshape(-1)
                sums[2 * k * k + y] += r.sum()
                for l in (0, 1):
                    sums[2 * k * k + 2 + 2 * y + l] += r[label == l].sum()
        cells = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(sums[cells])], ["cell", "value"])

    return run


def fit_labels(votes: DataFrame, rounds: int = 5) -> tuple[LabelModel, np.ndarray]:
    """The label model of ``votes`` (votes, label: -1 for none, n), and the pairs of its last round."""
    k, model = len(VOTERS), None
    labelled = votes.where("label >= 0").select("label").distinct().count() == 2
    pairs = np.zeros((2, k, k))
    for turn in range(rounds):
        sums = np.zeros(2 * k * k + 6)
        for r in votes.mapInArrow(_expected(model, FIRST_SHARE if labelled and not turn else 1.0), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            sums[r.cell] = r.value
        pairs = sums[: 2 * k * k].reshape(2, k, k)
        model = maximised(pairs, sums[2 * k * k : 2 * k * k + 2], sums[2 * k * k + 2 :].reshape(2, 2))
    return model, pairs


# ---- the classifier


class Toxicity(NamedTuple):
    """Fitted: features, a weight for each and for each voter, the weight of none, and the label model with the accuracies of its voters."""

    features: Features
    weights: np.ndarray
    base: float
    labels: LabelModel
    accuracies: dict[str, float]

    def scores(self, texts: list[str]) -> np.ndarray:
        found = look(texts, self.features)
        return 1 / (1 + np.exp(-np.clip(self.base + _sums(self.weights, *_inputs(found, len(self.features.hashes))), -500, 500)))


def _inputs(found: Found, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of what each text has, features first, then voters, and cuts."""
    fired = unpack(found.votes)
    text, voter = np.nonzero(fired)
    of = np.concatenate((np.repeat(np.arange(len(found.votes)), np.diff(found.cuts)), text))
    what = np.concatenate((found.feature, voter + n_features))
    order = np.argsort(of, kind="stable")
    return what[order], np.searchsorted(of[order], np.arange(len(found.votes) + 1))


def _sums(weights: np.ndarray, what: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[what])))
    return total[cuts[1:]] - total[cuts[:-1]]


def train(what: np.ndarray, cuts: np.ndarray, target: np.ndarray, share: np.ndarray, size: int, steps: int = 250, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic regression on soft targets, each text with its share of the loss."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not len(target):
        return w[:-1], -2.0
    share = share / share.sum()
    row = np.repeat(np.arange(len(target)), np.diff(cuts))
    w[-1] = np.log((share @ target + 1e-3) / (1 - share @ target + 1e-3))
    for step in range(1, steps + 1):
        wrong = share * (1 / (1 + np.exp(-np.clip(w[-1] + _sums(w, what, cuts), -500, 500))) - target)
        slope = np.append(np.bincount(what, weights=wrong[row], minlength=size) + decay * w[:-1], wrong.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class with each feature, added up over the partition: feature, kind, toxic, clean."""
    sums: dict[int, tuple] = {k: (np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64)) for k in KINDS}
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        words = words_of(_texts(batch.column("text")))
        for k, (h, word) in words.hashes.items():
            text = np.searchsorted(words.first, word, "right") - 1
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, label_of = h[new], label[text[new]]
            old, counts = sums[k]
            every, at = np.unique(np.concatenate((old, h)), return_inverse=True)
            total = np.zeros((len(every), 2), dtype=np.int64)
            total[at[: len(old)]] = counts
            for y in (0, 1):
                total[:, y] += np.bincount(at[len(old) :][label_of == y], minlength=len(every))
            sums[k] = every, total
    for k, (h, total) in sums.items():
        # What no toxic text of this part has is kept only where it is common: it may speak for clean.
        for at in range(0, len(h), 100_000):
            part = slice(at, at + 100_000)
            yield pa.record_batch([pa.array(h[part].view(np.int64)), pa.array(np.full(len(h[part]), k, dtype=np.int32)), pa.array(total[part, 1]), pa.array(total[part, 0])], ["feature", "kind", "toxic", "clean"])


def _watched(known: Features):
    """doc_id, votes and features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = look(_texts(batch.column("text")), known)
            lists = pa.ListArray.from_arrays(pa.array(found.cuts.astype(np.int32)), pa.array(found.feature.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.votes), lists], ["doc_id", "votes", "features"])

    return run


def _voted(known: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(look(_texts(batch.column("text")), known).votes)], ["doc_id", "votes"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = 6000, unlabelled: int = 3000) -> Toxicity:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``learn`` says of a doc_id whether both may be used."""
    spark = docs.sparkSession
    bounded_batches(spark)
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(learn)
    labels = labels.select(F.col("doc_id").cast("long"), "toxic").where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    by_hash = F.xxhash64("doc_id", F.lit(11))
    chosen = [labels.where(F.col("label") == y).orderBy(by_hash, "doc_id").limit(per_class) for y in (0, 1)]
    known_ids = materialise(chosen[0].union(chosen[1]), "toxicity-labelled")
    # At most 2 * per_class rows of two numbers.
    sample = materialise(docs.join(F.broadcast(known_ids), "doc_id").dropDuplicates(["text"]), "toxicity-texts")
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    counts = sample.repartition(16, F.xxhash64("doc_id")).mapInArrow(_counted, "feature long, kind int, toxic long, clean long")
    counts = counts.groupBy("feature", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p1, p0 = F.col("toxic") / max(n1, 1), F.col("clean") / max(n0, 1)
    p = (F.col("toxic") + F.col("clean")) / max(n1 + n0, 1)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    counts = materialise(counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).select("feature", "kind", "toxic", z.alias("z"), odds.alias("odds")), "toxicity-counts")
    toxic = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= STRENGTHS[-1]) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "feature").limit(MOST_TOXIC)
    clean = counts.where(F.col("z") <= -LEAST_Z).orderBy("z", "feature").limit(MOST_CLEAN)
    known = chosen_features([(r.feature & (1 << 64) - 1, r.kind, r.odds) for r in toxic.union(clean).collect()])

    votes = docs.mapInArrow(_voted(known), "doc_id long, votes long").groupBy("doc_id", "votes").agg(F.count("*").alias("n"))
    votes = votes.join(labels, "doc_id", "left").groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.sum("n").alias("n"))
    model, pairs = fit_labels(materialise(votes, "toxicity-votes"))

    others = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(labels, "doc_id", "left_anti").orderBy(by_hash, "doc_id").limit(unlabelled)
    others = docs.join(F.broadcast(materialise(others, "toxicity-others").distinct()), "doc_id").dropDuplicates(["text"])
    # At most 2 * per_class + unlabelled rows of numbers, each of at most MOST_TOXIC + MOST_CLEAN features.
    watched = sample.drop("label").union(others).mapInArrow(_watched(known), "doc_id long, votes long, features array<int>").join(F.broadcast(known_ids), "doc_id", "left")
    rows = watched.select("doc_id", "votes", "features", F.coalesce("label", F.lit(-1)).alias("label")).orderBy("doc_id").toArrow()
    label = rows.column("label").to_numpy()
    lists = rows.column("features").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    found = Found(lists.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))), rows.column("votes").to_numpy())
    # Each class of labels weighs as it does among all labels.
    every = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = np.where(label < 0, 1.0, 0.0)
    for y in (0, 1):
        share[label == y] = every.get(y, 0) / max((label == y).sum(), 1)
    share[label < 0] *= max(sum(every.values()), 1) / max(len(label), 1)
    what, cuts = _inputs(found, len(known.hashes))
    weights, base = train(what, cuts, model.posterior(found.votes, label), share, len(known.hashes) + len(VOTERS))
    return Toxicity(known, weights, base, model, model.accuracies(pairs))


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` (one is text) in a struct ``_row`` beside score and predicted, 1 from ``threshold`` on."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_texts(batch.column("_text")))
            yield pa.record_batch([batch.column("_row"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["_row", "score", "predicted"])

    own = packed(docs, F.col("text").alias("_text"))
    return own.mapInArrow(run, StructType([own.schema["_row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
