"""The corpus operators against brute force on small tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from halocline.llm import decontaminate, html_text, language_id, licenses, line_dedup, lm_score, near_copies, pieces, quality, queries, simhash, substring_dedup

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(n: int) -> str:
    return " ".join(f"w{int(x)}" for x in RNG.integers(0, 4000, n))


PASSAGE = _prose(60)
BASE = _prose(300)
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, BASE.replace("w", "W", 3), None, None, None),
    (4, _prose(50) + " " + PASSAGE + "\n" + _prose(20), "en", "a", 1),
    (5, PASSAGE + " " + _prose(30), "fr", "b", 1),
    (6, None, None, "a", None),
    (7, "", "en", "a", 0),
    (8, " \t\n ", "en", None, 4),
    (9, _prose(20000), "en", "a", 1),
    (None, "one line\nonly three words here", "en", "a", 1),
    (1, BASE, "en", "a", 1),
    (11, "x " * 400, "en", "a", 800),
    *[(20 + i, f"Common Line \n{_prose(30)}\n\ncommon line\nü{i}", "en", "a", 1) for i in range(12)],
]


def _words(text):
    return WORDS.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators also use.
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit("mine")).withColumn("samples", F.lit(1)).withColumn("kept", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _fingerprint(text: str | None, n: int) -> int:
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in _words(text)]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    got = simhash.near_duplicates(docs).collect()
    fp = {}
    for i, text, *_ in ROWS:
        fp.setdefault(_fingerprint(text, 4), []).append(i)
    parent = {f: f for f in fp}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fp:
        for b in fp:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for f, ids in fp.items():
        known = [i for i in ids if i is not None]
        least[root(f)] = min([*known, *([least[root(f)]] if least.get(root(f)) is not None else [])], default=None)
    want = sorted((str(i), f, least[root(f)]) for f, ids in fp.items() for i in ids)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


def test_ball_edges_join_all_pairs_in_reach(spark):
    base = RNG.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in RNG.choice(64, d, replace=False)) for b in base for d in range(0, 7)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    edges = simhash.ball_edges(spark.createDataFrame(signed, "fp long"), 5_000_000, 4).collect()
    from halocline.llm.common import local_components

    names = sorted(prints)
    at = {x: k for k, x in enumerate(names)}
    got = local_components(*[np.array([at[r[c] & (1 << 64) - 1] for r in edges], dtype=int) for c in "ab"], len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i) if (names[i] ^ names[j]).bit_count() <= 4]
    want = local_components(*[np.array([p[c] for p in pairs], dtype=int) for c in (0, 1)], len(names))
    assert (got == want).all()


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(docs):
    rows = {(i, t) for i, t, *_ in ROWS}
    n = {}
    for i, t in rows:
        for k in {_key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    gone = {k for k, c in n.items() if c >= 10 and len(k) >= 1}
    want = sorted((str(i), "\n".join(x for x in (t or "").split("\n") if _key(x) not in gone), len((t or "").split("\n"))) for i, t, *_ in ROWS)
    got = line_dedup.dedup_lines(docs, 10, 1)
    assert sorted((str(r.doc_id), r.text, r._n_lines) for r in got.collect()) == want
    kept_once = line_dedup.dedup_lines(docs, 10, 1, keep_first=True).where("doc_id = 20").first()
    assert kept_once.text.startswith("Common Line \n") and kept_once._n_dropped == 1


def test_line_keys_of_long_lines(spark):
    """A line of a million spaces inside costs what its length costs."""
    rows = [(f" \t{x}\n\x0b\x0c\r ", x) for x in ("A" + " " * 1_000_000 + "b", "Ünd ÄB", "", "a\u00a0", "\u2003a")]
    df = spark.createDataFrame(rows, "line string, want string")
    start = time.time()
    got = df.select(line_dedup.line_key(F.col("line")).alias("key"), "want").collect()
    assert time.time() - start < 20
    assert [r.key for r in got] == [_key(r.want) for r in got]


def test_substring_dedup(docs):
    every = [_words(t) for _, t, *_ in ROWS]
    n = {}
    for w in every:
        for p in range(len(w) - 34):
            n[tuple(w[p : p + 35])] = n.get(tuple(w[p : p + 35]), 0) + 1
    want = []
    for (i, *_), w in zip(ROWS, every):
        gone = {q for p in range(len(w) - 34) if n[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        want.append((str(i), len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    got = substring_dedup.remove_repeats(docs, 35, batch_bytes=4000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)


def test_quality_measures(docs):
    want = []
    for i, t, *_ in ROWS:
        w, lines = _words(t), [x for x in (t or "").split("\n") if _words(x)]
        grams = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        times = Counter(grams)
        many = {g for g, n in times.items() if n > 1}
        repeat = len({q for p, g in enumerate(grams) if g in many for q in range(p, p + 8)})
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w)))
    got = quality.clean_lines(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rejects_menus_and_keeps_prose(spark):
    prose = "\n".join(_prose(15) for _ in range(4))
    menu = "\n".join("Home | News | About | Contact | Shop" for _ in range(6)) + "\n" + _prose(20)
    got = {r.doc_id: r.kept for r in quality.clean_lines(spark.createDataFrame([(1, prose), (2, menu)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seventeen green bottles hang upon the garden wall"
    near = item.replace("quick", "quikc").replace("green", "grean")
    far = " ".join(item.split()[::-1])
    rows = [(1, f"{_prose(30)} {item.upper()} {_prose(30)}"), (2, f"{_prose(9)}\n{near}\n{_prose(5)}"), (3, far), (4, None), (5, ""), (6, _prose(5000)), (None, item)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "  "), (7, item)], "item_id long, text string")
    got = decontaminate.passages(docs_, bench).collect()
    assert sorted({(str(r.doc_id), r.item_id) for r in got}) == [("1", 7), ("2", 7), ("None", 7)]
    assert {r.edits for r in got if r.doc_id == 1} == {0} and {0 < r.edits <= 8 for r in got if r.doc_id == 2} == {True}
    assert sorted(r.doc_id for r in decontaminate.clean(docs_, bench).collect()) == [3, 4, 5, 6]


def test_pieces_round_trip_and_samples(docs):
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "samples")
    coded = pieces.decode(pieces.encode(texts, F.col("doc_id"), k=2), F.col("samples.ids")).collect()
    for r in coded:
        assert r.decoded == [r.text] * len(r.samples)
        ids = [tuple(s.ids) for s in r.samples]
        assert len(set(ids)) == len(ids) == (2 if len(r.text) > 3 else len(ids))
        assert all(0 <= s.inclusion <= 1 for s in r.samples)
    checked = pieces.encode_checked(docs.select("doc_id", "text", "samples"), F.col("doc_id"), k=2).collect()
    assert sorted((str(r.doc_id), r.samples) for r in checked) == sorted((str(r.doc_id), r.samples) for r in coded)
    assert all(r.round_trip for r in checked)
    again = pieces.encode(texts.where("doc_id = 4"), F.col("doc_id"), k=2).first()
    assert [list(s.ids) for s in again.samples] == [list(s.ids) for r in coded if r.doc_id == 4 for s in r.samples]


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a><a>News</a></nav><article><h1>A &amp; B</h1><p>First  paragraph of the\n article, which has a good number of ordinary words in it.</p><p>Second paragraph, also with a good number of ordinary words.</p></article><footer>Copyright 2020</footer><script>var x=1</script></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert "First paragraph of the article, which" in got[1] and "A & B" in got[1]
    assert not any(x in got[1] for x in ("Home", "Copyright", "var x", "p{}"))
    assert got[2] == got[3] == ""


def test_language_held_out_accuracy(spark):
    found = queries.op8_language_id(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert held >= 0.95


def test_language_without_anything_to_learn(docs, empty):
    model = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}


def test_lm_base_score(docs):
    plain = docs.select("doc_id", "text")
    got = lm_score.score(plain, learn=F.coalesce(F.col("doc_id"), F.lit(0)) > 4, held_out=F.coalesce(F.col("doc_id"), F.lit(0)) <= 4).collect()
    count, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in ROWS:
        if (i or 0) > 4:
            for w in [*_words((t or "").translate(lower)), None]:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    base = lambda t: sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in [*_words((t or "").translate(lower)), None])
    want = {str(i): base(t) for i, t, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert r.train_tokens == total and r.score <= 0 and np.isfinite(r.score)
        assert abs(r.base_score - want[str(r.doc_id)]) < 1e-6 * abs(want[str(r.doc_id)])


def test_license_scan(spark):
    rows = [(1, "Some text here\nLicensed under the Apache License, Version 2.0"), (2, "We met the mayor and took the free bus to the garden"), (3, None), (4, ""), (None, "Released under the MIT License"), (1, "Some text here\nLicensed under the Apache License, Version 2.0")]
    lines = [(100 + i, f"{_prose(12)}\nplain words about rivers and use of the land in any form") for i in range(40)]
    got = licenses.scan(spark.createDataFrame(rows + lines, "doc_id long, text string").withColumn("family", F.lit("x"))).collect()
    assert len(got) == len(rows) + 40
    assert sorted((str(r.doc_id), r.families) for r in got if r.families) == [("1", "apache"), ("1", "apache"), ("None", "mit")]


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert quality.clean_lines(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert pieces.encode(empty.select("doc_id", "text"), F.col("doc_id"), k=2).count() == 0
    assert decontaminate.passages(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert lm_score.score(empty.select("doc_id", "text"), learn=F.lit(True), held_out=F.lit(False)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, SMALL)
        assert docs_.columns == columns, name
        docs_ = spark.createDataFrame(docs_.collect(), docs_.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs_, SMALL).collect()
    assert len(last) == docs_.count() > 100 and all(r.round_trip for r in last)


def test_digest_queries_have_their_columns(spark):
    out = queries.op6_line_dedup(spark, SMALL).first()
    assert len(out.kept_sha256) == len(hashlib.sha256().hexdigest())


def test_columns_with_clashing_names_pass_through(spark):
    names = ["_th", "_row", "_hits", "_lines", "_kept", "_bits", "_drops", "_doc", "_id", "_stay", "score", "lang_pred", "_lang", "samples", "has space"]
    rows = [(i, f"{_prose(40)}\nthe same line\n{_prose(5)}", "en", "a", 1, *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[0]], SCHEMA + "".join(f", `{n}` string" for n in names))
    items = spark.createDataFrame([(1, _prose(20))], "item_id long, text string")
    line = line_dedup.dedup_lines(docs, 10, 1).drop("_n_lines", "_n_dropped")
    outs = [line, decontaminate.clean(docs, items), simhash.one_of_each(docs), near_copies.one_of_each(docs), corpus_pipeline.language(spark, docs, ""), corpus_pipeline.lines(spark, docs, "")]
    for out in outs:
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {r[5:] for r in rows}


def test_an_odd_radius_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.ball_edges(spark.createDataFrame([(1,)], "fp long"), 1, 3)
