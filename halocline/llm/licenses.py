"""License scan: a trained paragraph classifier, in DataFrame and Spark ML functions only.

Paragraphs are lines, and runs of neighbouring non-blank lines joined by spaces:
runs of each of RUN_LINES lengths that start at any line, cut off at blank lines,
so that notices broken over lines are whole in one of them. A run counts as its
lines: a hit marks each line of the shortest run that has it. A template's
DISTINCT words must occur, so that a notice is not taken for another family's.

Features are word 1- to 3-grams; the vocabulary is that of
the notice templates below, so a line without any of them has the score of an
empty line, which is unknown, and is set aside before scoring. A multinomial
logistic regression with an L1 penalty is fitted on variants of the templates and
on a bounded sample of the corpus's lines (``sample_lines``, by hash order) as
the unknown class. Margins over unknown become probabilities by a logistic fit on
held-out variants and lines. A prediction stands if that probability is 0.5 or
more and the paragraph compares with a template of its family: enough of the
template's words, and enough of its neighbouring pairs of words as neighbours.

A long text has as many paragraphs as lines and none is cut. Of predictions that
tie the class first in the alphabet counts; of runs that tie the likelier one.

Null and empty texts have one empty line and no licence. Repeated rows are
judged one by one and told apart by doc_id and text; rows that repeat both give
one row of the result each. Null doc_id is allowed; other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

#: Short notices of public licences. {v} is a version number.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version {v}"),
    ("apache", "Licensed under the Apache License, Version {v} (the License); you may not use this file except in compliance with the License"),
    ("apache", "Apache License Version {v}"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("bsd", "Licensed under the BSD license"),
    ("cc", "Licensed under CC BY-NC {v}"),
    ("cc", "Licensed under CC BY-SA {v}"),
    ("cc", "Licensed under CC BY {v}"),
    ("cc", "This work is licensed under a Creative Commons Attribution {v} International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version {v}"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or any later version"),
    ("gpl", "Released under the GNU GPL version {v}"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version {v}"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {v} of the License, or any later version"),
    ("agpl", "Licensed under the GNU Affero General Public License, version {v}"),
    ("agpl", "Released under the GNU AGPL version {v}"),
    ("artistic", "Licensed under the Artistic License {v}"),
    ("boost", "Distributed under the Boost Software License, Version {v}"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}"),
    ("epl", "Licensed under the Eclipse Public License {v}"),
    ("isc", "Released under the ISC License"),
    ("isc", "Licensed under the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or any later version"),
    ("lgpl", "Released under the GNU LGPL version {v}"),
    ("public domain", "This is free and unencumbered software released into the public domain"),
    ("public domain", "Dedicated to the public domain under CC0 {v}"),
)
VERSIONS = ("1.0", "2.0", "3", "4.0")
AROUND = (("", ""), ("Note: ", ""), ("", " All rights reserved"), ("Copyright 2020 the authors. ", ""), ("", " See the file for details"))
#: Words too common to be features by themselves.
COMMON = ("a", "and", "any", "are", "as", "by", "can", "either", "for", "form", "forms", "following", "free", "in", "into", "is", "it", "later", "may", "met", "not", "of", "or", "person", "program", "that", "the", "this", "to", "under", "use", "v", "version", "with", "without", "work", "you")
UNKNOWN = "unknown"
#: Words that a template which has them must find, and that a template without them must not find.
DISTINCT = ("affero", "agpl", "apache", "artistic", "attribution", "boost", "bsd", "cc", "creative", "eclipse", "gpl", "isc", "lesser", "lgpl", "mit", "mozilla")
#: Lengths of runs of lines; the standard notices broken at 60 columns or more have up to 16 lines.
RUN_LINES = (1, 2, 3, 4, 6, 8, 12, 16, 24)


@dataclass(frozen=True)
class LicenseScanner:
    vocabulary: list[str]
    families: list[str]
    model: LogisticRegressionModel
    #: Slope and intercept that make a margin over unknown a probability, from held-out paragraphs.
    slope: float
    intercept: float


def _tokens(line: Column) -> Column:
    """Lower-case words without punctuation and digits; a version number leaves nothing."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}]+"), "")


def _grams(words: str) -> Column:
    """Distinct 1- to 3-grams, so that features are 0 or 1."""
    parts = [words] + [f"CASE WHEN size({words}) < {n} THEN array() ELSE transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')) END" for n in (2, 3)]
    return F.expr(f"array_distinct(concat({', '.join(parts)}))")


def _variants(spark: SparkSession) -> DataFrame:
    rows = []
    for family, text in TEMPLATES:
        for version in VERSIONS if "{v}" in text else VERSIONS[:1]:
            for before, after in AROUND:
                rows.append((family, before + text.format(v=version) + after))
    return spark.createDataFrame(rows, "family string, line string")


def _vectors(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    df = df.withColumn("_grams", _grams("_tokens"))
    return CountVectorizerModel.from_vocabulary(vocabulary, "_grams", "features", minTF=1.0).transform(df).drop("_grams")


def _shares_words(single: list[str]) -> Column:
    return F.arrays_overlap("_tokens", F.array(*map(F.lit, single)))


def fit(docs: DataFrame, sample_lines: int = 2000) -> LicenseScanner:
    """``sample_lines`` bounds the corpus lines of the unknown class: those of least hash among lines of 3 words or more."""
    spark = docs.sparkSession
    known = _variants(spark).withColumn("_tokens", _tokens(F.col("line")))
    words = set(COMMON)
    vocabulary: set[str] = set()
    for _, text in TEMPLATES:
        w = [x for x in "".join(c if c.isalpha() else " " for c in text.replace("{v}", "").lower()).split() if x]
        for n in (1, 2, 3):
            vocabulary |= {" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if not set(w[i : i + n]) <= words}
    terms = sorted(vocabulary)
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    sample = lines.select("line", F.xxhash64("doc_id", "line").alias("_o")).where("length(line) >= 12").orderBy("_o", "line").limit(sample_lines)
    # A sampled line that is a notice itself would teach the opposite: drop those that share half of a template.
    likely = _template_share("_tokens")
    unknown = sample.withColumn("_tokens", _tokens(F.col("line"))).withColumn("_like", likely).where("_like < 0.5").select(F.lit(UNKNOWN).alias("family"), "line", "_tokens")
    bare = spark.createDataFrame([(UNKNOWN, "")], "family string, line string").withColumn("_tokens", _tokens(F.col("line")))
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    rows = known.select("family", "line", "_tokens").union(unknown).union(bare)
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    rows = _vectors(rows, terms).withColumn("_fold", F.pmod(F.xxhash64("line"), F.lit(4))).coalesce(1).cache()
    model = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=60).fit(rows.where("_fold <> 0"))
    held = _probable(model.transform(rows.where("_fold = 0"))).select("_margin", (F.col("label") > 0).cast("double").alias("label"))
    slope, intercept = _calibration(held)
    rows.unpersist()
    return LicenseScanner(terms, families, model, slope, intercept)


def _calibration(held: DataFrame) -> tuple[float, float]:
    """Platt's fit: margins of held-out paragraphs to the probability of a licence. Without both kinds margins stand as log-odds."""
    kinds = held.agg(F.countDistinct("label").alias("n")).first()["n"]
    if kinds < 2:
        return 1.0, 0.0
    fitted = LogisticRegression(regParam=1e-3, maxIter=50, standardization=False).fit(VectorAssembler(inputCols=["_margin"], outputCol="features").transform(held))
    # A paragraph never is likelier a notice for a lesser margin.
    return max(0.0, float(fitted.coefficients[0])), float(fitted.intercept)


def _probable(scored: DataFrame) -> DataFrame:
    """_best: the largest probability of a licence; _at: its class; _margin: its log-odds over unknown."""
    p = settled(scored.withColumn("_p", vector_to_array("probability")))
    best = F.expr("array_max(slice(_p, 2, size(_p) - 1))")
    at = F.expr("array_position(slice(_p, 2, size(_p) - 1), array_max(slice(_p, 2, size(_p) - 1)))")
    margin = F.log(F.greatest(best, F.lit(1e-12))) - F.log(F.greatest(F.col("_p")[0], F.lit(1e-12)))
    return p.withColumn("_best", best).withColumn("_at", at).withColumn("_margin", margin)


def _template_words(text: str) -> list[str]:
    return sorted({x for x in "".join(c if c.isalpha() else " " for c in text.replace("{v}", "").lower()).split() if x})


def _template_share(tokens: str, family: Column | None = None) -> Column:
    """Largest share of a template's distinct words that the paragraph has, over all templates or those of its family.

    With a family, templates count whose own DISTINCT words all occur; without
    any of its own, those of paragraphs without DISTINCT words of another family.
    """
    shares = []
    named = {f: {w for g, t in TEMPLATES if g == f for w in _template_words(t)} for f, _ in TEMPLATES}
    for name, text in TEMPLATES:
        w = _template_words(text)
        share = F.size(F.array_intersect(F.array(*map(F.lit, w)), F.col(tokens))) / F.lit(len(w))
        own = [x for x in w if x in DISTINCT]
        other = [x for x in DISTINCT if x not in named[name]]
        fits = F.size(F.array_intersect(F.array(*map(F.lit, own)), F.col(tokens))) == len(own) if own else ~F.arrays_overlap(F.col(tokens), F.array(*map(F.lit, other)))
        shares.append(F.when((family == name) & fits, share).otherwise(0.0) if family is not None else share)
    return F.greatest(*shares)


def _in_order(tokens: str, family: Column) -> tuple[Column, Column]:
    """_pairs, and from them the largest share of a template's neighbouring word pairs that the paragraph has as neighbours too, over templates of the family; 1 for a template of one word."""
    pairs = F.expr(f"CASE WHEN size({tokens}) < 2 THEN array() ELSE transform(sequence(1, size({tokens}) - 1), i -> array_join(slice({tokens}, i, 2), ' ')) END")
    shares = []
    for name, text in TEMPLATES:
        w = "".join(c if c.isalpha() else " " for c in text.replace("{v}", "").lower()).split()
        own = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        share = F.size(F.array_intersect(F.array(*map(F.lit, own)), F.col("_pairs"))) / F.lit(float(len(own))) if own else F.lit(1.0)
        shares.append(F.when(family == name, share).otherwise(0.0))
    return pairs, F.greatest(*shares)


def _runs(docs: DataFrame, single: list[str]) -> DataFrame:
    """doc_id, _th, position, n_lines, line, _tokens: lines, and runs of lines without a blank one, that have a word of a template.

    The words of a line are split once. Of runs, those are left that start in a line with
    such a word or after a blank one, and end in one, before a blank line or with the text.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.split("text", "\n").alias("_lines"))
    lines = settled(lines.withColumn("_words", F.transform("_lines", _tokens)))
    known = F.array(*map(F.lit, single))
    lines = settled(lines.withColumn("_hit", F.transform("_words", lambda w: F.arrays_overlap(w, known)))).where(F.exists("_hit", lambda x: x))
    # How many lines from each one there are up to a blank one or the end, and more than any run has if that is far: longer runs are cut off there.
    most = max(RUN_LINES)
    lines = settled(lines.withColumn("_blank", F.transform("_words", lambda w: F.size(w) == 0)))
    open_ = f"coalesce(nullif(array_position(slice(_blank, i + 1, {most + 1}), true), 0) - 1, least({most + 1}, size(_lines) - i))"
    lengths = ", ".join(map(str, RUN_LINES))
    at = f"""flatten(transform(filter(sequence(0, size(_lines) - 1), i -> _hit[i] OR (NOT _blank[i] AND (i = 0 OR _blank[greatest(i - 1, 0)]) AND exists(slice(_hit, i + 1, {most}), x -> x))), i ->
                transform(array_distinct(transform(array({lengths}), n -> CAST(least(n, greatest(1, {open_})) AS INT))),
                          n -> struct(i AS position, n AS n_lines, n = {open_} AS whole))))"""
    runs = settled(lines.withColumn("_run", F.explode(F.expr(at)))).where("_run.whole OR _hit[_run.position + _run.n_lines - 1]")
    return runs.select(
        "doc_id", "_th", F.col("_run.position").cast("int").alias("position"), F.col("_run.n_lines").cast("int").alias("n_lines"),
        F.expr("array_join(slice(_lines, _run.position + 1, _run.n_lines), ' ')").alias("line"),
        F.expr("flatten(slice(_words, _run.position + 1, _run.n_lines))").alias("_tokens"),
    )


def license_paragraphs(docs: DataFrame, scanner: LicenseScanner, least_share: float = 0.7, least_order: float = 0.5, least_probability: float = 0.5) -> DataFrame:
    """One row per line or run of lines that is a licence notice: doc_id, _th, position, n_lines, line, family, probability, template_share."""
    single = [t for t in scanner.vocabulary if " " not in t]
    # Each step is settled: Spark would otherwise write one step's expression into every use of it in the next.
    runs = settled(_runs(docs, single)).withColumn("_likely", _template_share("_tokens"))
    # A run below the share for all families cannot have it for one.
    runs = settled(runs).where(F.col("_likely") >= least_share).drop("_likely")
    scored = settled(_probable(scanner.model.transform(_vectors(settled(runs), scanner.vocabulary))).drop("features", "rawPrediction", "probability", "prediction", "_p"))
    probability = 1 / (1 + F.exp(-(F.col("_margin") * scanner.slope + scanner.intercept)))
    scored = scored.withColumn("_best", probability)
    family = F.element_at(F.array(*map(F.lit, scanner.families[1:])), F.col("_at").cast("int"))
    hits = settled(scored.where(F.col("_best") >= least_probability).withColumn("family", family))
    hits = settled(hits.withColumn("template_share", _template_share("_tokens", F.col("family")))).where(F.col("template_share") >= least_share)
    pairs, in_order = _in_order("_tokens", F.col("family"))
    hits = settled(hits.withColumn("_pairs", pairs)).where(in_order >= least_order)
    return hits.select("doc_id", "_th", "position", "n_lines", "line", "family", F.col("_best").alias("probability"), "template_share")


def scan(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_license_paragraphs, families (sorted, by comma), probability (largest or null)."""
    hits = license_paragraphs(docs, scanner or fit(docs))
    # Of the runs that a line is in, only the shortest with a hit counts.
    lines = hits.withColumn("_line", F.explode(F.expr("sequence(position, position + n_lines - 1)")))
    hits = lines.groupBy("doc_id", "_th", F.col("_line").alias("position")).agg(F.min(F.struct("n_lines", -F.col("probability"), "family")).alias("_b")).select("doc_id", "_th", "position", F.col("_b.family").alias("family"), (-F.col("_b.col2")).alias("probability"))
    found = hits.groupBy("doc_id", "_th").agg(F.countDistinct("position").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("p"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("_th").alias("_doc_th"), "n", "families", "p")
    own = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_paragraphs"))
    out = own.join(found, own["doc_id"].eqNullSafe(found["_doc"]) & (own["_th"] == found["_doc_th"]), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.col("p").alias("probability"))
