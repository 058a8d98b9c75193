"""Queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, licenses, line_dedup, lm_score, merkle, periodic_runs, pieces, quality, simhash, substring_dedup, toxicity
from .common import id_crc32, read, remainder


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder(F.col("doc_id"), 7)
    return lm_score.score(read(spark, sf_dir, "documents"), learn=fold != 2, held_out=fold == 2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two sampled segmentations of every document, whole, with their scores and digest, and whether each decodes to the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = pieces.encode_checked(docs, F.col("doc_id"), k=2)
    return coded.select(
        "doc_id",
        F.size("samples").cast("long").alias("n_samples"),
        F.transform("samples", lambda s: F.size(s["ids"]).cast("long")).alias("n_pieces"),
        F.col("samples.ids").alias("ids"),
        F.col("samples.log_prob").alias("log_prob"),
        F.col("samples.perturbed").alias("perturbed"),
        F.col("samples.inclusion").alias("inclusion"),
        F.xxhash64("samples.ids").alias("ids_xxh64"),
        "round_trip",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = remainder(F.col("doc_id"), 3)
    model = language_id.fit(docs, fold != 1)
    out = language_id.identify(docs.drop("lang"), model, reject=False)
    rejected = (F.col("lang_pred") == language_id.UNDETERMINED) | (F.col("score") < model.least_cosine)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", rejected.alias("rejected"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(read(spark, sf_dir, "documents")).drop("cleaned", "lost_share")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder(F.col("doc_id"), 4)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold != 2)
    out = toxicity.score(docs.withColumn("held_out", fold == 2), model, threshold=0.3)
    return out.select("_row.doc_id", "_row.held_out", "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether the manifest notices that a third of the documents were lower-cased."""
    docs = read(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: merkle.digest(*[docs[c] for c in ("doc_id", "source", "lang", "n_chars")], text)
    tampered = F.when(remainder(docs["doc_id"], 3) == 0, leaf(F.translate(docs["text"], capitals, capitals.lower())))
    rows = docs.select("doc_id", "lang", leaf(docs["text"]).alias("own"), tampered.alias("tampered"))
    out = merkle.manifest(rows, F.col("lang"), F.col("doc_id"), F.col("own"))
    out = out.select("_row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("_row.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; a tenth of the documents repeat a stretch of theirs up to the end."""
    docs = read(spark, sf_dir, "documents")
    h = id_crc32(F.col("doc_id"))
    g = F.floor(h / 10)

    def place(n: Column) -> tuple[Column, Column]:
        return g % n, F.lit(1) + F.floor((n - g % n) / (3 + g % 8))

    text = periodic_runs.with_repeats(F.col("text"), h % 10 == 0, place)
    out = periodic_runs.runs_of(docs.select("doc_id", text.alias("text")), digests=True)
    return out.select(
        "_row.doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.col("runs").alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_lm_score": op2_lm_score,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_pieces": op5_pieces,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The default QualityRules of op10, for its SQL.
_RULES = quality.QualityRules()
_BARS = " + ".join(f"(length(line) - length(replace(line, '{x}', ''))) / {len(x)}.0" for x in quality.SPACED_SEPARATORS)

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: crc32 of a text in DuckDB: the table of its bytes, then a step for each byte.
_CRC_TABLE = "(SELECT list(list_reduce([i] || range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) FROM range(256) r(i))"
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc.bytes[xor(a & 255, b) + 1])), 4294967295)"
_TRANSLATED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE_SQL = {
    "op12_merkle_manifest": rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS bytes),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf, CASE WHEN {_CRC32.format(text="doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_TRANSLATED)} ELSE {_leaf("text")} END AS other FROM documents, crc),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM e UNION ALL
          SELECT tree, level + 1, i // {merkle.ARITY}, sha256(string_agg(h, '' ORDER BY i)), (n + {merkle.ARITY - 1}) // {merkle.ARITY} FROM nodes WHERE n > 1 GROUP BY tree, level, n, i // {merkle.ARITY}),
subroots AS (SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, subroot AS h, n FROM subroots UNION ALL
         SELECT level + 1, i // {merkle.ARITY}, sha256(string_agg(h, '' ORDER BY i)), (n + {merkle.ARITY - 1}) // {merkle.ARITY} FROM tops WHERE n > 1 GROUP BY level, n, i // {merkle.ARITY}),
every AS (SELECT tree, level, i, h, n FROM nodes UNION ALL SELECT '*', level, i, h, n FROM tops),
sides AS (SELECT tree, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM every WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, i // {merkle.ARITY} ORDER BY i)),
steps AS (SELECT e.tree, e.i, s.level, s.l, s.r FROM e JOIN sides s ON s.tree = e.tree AND s.i = e.i // ({merkle.ARITY} ** s.level)::BIGINT
          UNION ALL SELECT e.tree, e.i, t.height + s.level, s.l, s.r FROM e JOIN subroots t ON e.tree = t.tree JOIN sides s ON s.tree = '*' AND s.i = t.i // ({merkle.ARITY} ** s.level)::BIGINT),
paths AS (SELECT tree, i, list(l || '|' || r ORDER BY level) AS path FROM steps GROUP BY tree, i),
f AS (SELECT e.doc_id, e.leaf, t.subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(path, []) AS path, other FROM e JOIN subroots t ON e.tree = t.tree LEFT JOIN paths p ON p.tree = e.tree AND p.i = e.i),
g AS (SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, list_reduce([other] || path, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
""",
    "op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM h WHERE h IN (SELECT h FROM twice)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(gone.q)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.q) FILTER (e.q IS NOT NULL AND gone.q IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.q = gone.q
GROUP BY d.doc_id
""",
    "op10_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
h AS (SELECT r, p, md5(array_to_string(w[p:p + {_RULES.window - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {_RULES.window - 2})) AS p FROM d WHERE len(w) >= {_RULES.window})),
twice AS (SELECT r, h FROM h GROUP BY r, h HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT h.r, unnest(range(p, p + {_RULES.window})) AS q FROM h JOIN twice ON h.r = twice.r AND h.h = twice.h) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
m AS (SELECT *, length(regexp_replace(line, '[{quality.SPACE}]+', '', 'g')) AS solid, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
             regexp_replace(line, '[{quality._PLAIN}{quality.SPACE}]+', '', 'g') AS marks, lower(line) AS low, rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM l),
k AS (SELECT *, length(marks) AS n, length(marks) - length(regexp_replace(marks, '[{quality._SYMBOLS}]+', '', 'g')) AS symbols,
             length(marks) - length(regexp_replace(marks, '[{quality.SEPARATORS}]+', '', 'g')) + {_BARS} AS bars FROM m),
j AS (SELECT r, i, line, solid, words, symbols,
             CASE WHEN words = 0 THEN 'b' WHEN rtrim(tail, '{quality.CLOSERS.replace("'", "''")}') <> '' AND contains('{quality.SENTENCE_ENDS}', right(rtrim(tail, '{quality.CLOSERS.replace("'", "''")}'), 1)) THEN 'e' WHEN words <= {_RULES.most_menu_words} THEN 'm' WHEN words <= {_RULES.most_unended_words} THEN 'u' ELSE 'o' END AS c,
             words > 0 AND (symbols > solid * {_RULES.most_symbol_share} OR (n >= 3 AND n > solid * {_RULES.most_punctuation_share})
               OR len(list_filter(string_split(marks, ''), lambda x: x <> '' AND contains(line, repeat(x, {_RULES.punctuation_run})))) > 0
               OR (n >= 3 AND bars >= greatest(3, words * {_RULES.least_menu_share}))
               OR (words <= {_RULES.most_boilerplate_words} AND regexp_matches(low, '(^|[^a-z0-9_])({'|'.join(quality.BOILERPLATE)})'))) AS bad,
             tail LIKE '%{quality.DOTS[0]}' OR tail LIKE '%{quality.DOTS[1]}' AS dotted, regexp_matches(line, '{quality.BULLETS}') AS bulleted FROM k),
a AS (SELECT r, string_agg(c, '' ORDER BY i) AS c, greatest(1, count(*) FILTER (words > 0)) AS filled, count(*) FILTER (c = 'e') AS ended, count(*) FILTER (dotted) AS dotted, count(*) FILTER (bulleted) AS bulleted FROM j GROUP BY r),
s AS (SELECT j.r, sum(solid)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, (count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0))::BIGINT AS n_dup_lines,
             sum(CASE WHEN bad OR (j.c = 'm' AND contains(substr(repeat('.', {_RULES.menu_run - 1}) || a.c || repeat('.', {_RULES.menu_run - 1}), i::BIGINT, {2 * _RULES.menu_run - 1}), repeat('m', {_RULES.menu_run})))
               OR (j.c IN ('m', 'u') AND a.ended >= {_RULES.least_ended_share} * filled) OR (j.dotted AND a.dotted >= {_RULES.least_dotted_share} * filled)
               OR (j.bulleted AND a.bulleted >= {_RULES.least_bulleted_share} * filled) THEN 0 ELSE solid END)::BIGINT AS remaining FROM j JOIN a ON j.r = a.r GROUP BY j.r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, remaining FROM d JOIN s ON d.r = s.r LEFT JOIN again ON d.r = again.r),
f AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.most_repeat_percent} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN word_chars > 0 THEN 1 - remaining / word_chars ELSE 0 END <= {_RULES.most_lost_share} AS kept FROM f
""",
}
