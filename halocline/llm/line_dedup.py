"""Line dedup over a whole corpus, in DataFrame functions only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
Lines travel as two 64-bit hashes of the key with document and position, never
as text. They are range-partitioned by hash and sorted by document and position
within it; a scan in that order marks a document's first line of each key. A key
is dealt into salts by document, so a line of a third of all documents is counted
in many tasks and the counts are added up. What returns to the documents is one
bitmap each of the lines to drop, as (word of 64 positions, bits).

Null text is one empty line. A row that repeats doc_id and text is the same
document: it counts once and gets the same result. Null doc_id is allowed. Long
texts and long lines are whole: a text's bitmap has a word for each 64 lines. Of lines
that tie as first the one of the least document, then position, is first. An empty
table gives an empty result.
Columns other than doc_id and text pass through ``dedup_lines`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, packed

SPACE = "\x20\x09\x0A\x0B\x0C\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Deals of one key; documents of a key spread over these.
SALTS = 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select("doc_id", "_th", "pos", line_key(F.col("line")).alias("key"))


def drop_bitmaps(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document that loses lines: doc_id, _th (hash of the text) and drops, a map of word number to 64 bits.

    A key of at least ``min_chars`` code points in at least ``min_documents``
    documents loses all lines, or all but its first (least doc_id, then
    position) with ``keep_first``.
    """
    hashed = _lines(docs).where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "_th", "pos")
    lines = materialise(hashed, "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_th"), F.lit(SALTS)))
    dealt = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "_th", "pos")
    in_order = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "_th", "pos")
    before = F.lag(F.struct("doc_id", "_th")).over(in_order)
    opens = before.isNull() | ~before.eqNullSafe(F.struct("doc_id", "_th"))
    firsts = dealt.withColumn("opens", opens).where("opens")
    first = [F.min(F.struct("doc_id", "_th", "pos")).alias("first")] if keep_first else []
    of_salt = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), *first)
    of_key = of_salt.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *([F.min("first").alias("first")] if keep_first else []))
    frequent = materialise(of_key.where(F.col("n") >= min_documents).drop("n"), "frequent")
    drop = lines.join(frequent, ["h1", "h2"])
    if keep_first:
        drop = drop.where(~F.col("first").eqNullSafe(F.struct("doc_id", "_th", "pos")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = drop.groupBy("doc_id", "_th", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with text replaced by its kept lines joined by \\n, and _n_lines and _n_dropped added; other columns as they are, whatever their names."""
    maps = drop_bitmaps(docs, min_documents, min_chars, keep_first).select(F.col("doc_id").alias("_doc"), F.col("_th").alias("_doc_th"), F.col("drops").alias("_drops"))
    own = packed(docs, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    joined = own.join(maps, own["_id"].eqNullSafe(maps["_doc"]) & (own["_th"] == maps["_doc_th"]), "left")
    lines = F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n")
    # The map becomes a dense list of 64-bit words, read by position.
    dense = "CASE WHEN _drops IS NULL THEN NULL ELSE transform(sequence(0, (size(_lines) - 1) div 64), w -> coalesce(try_element_at(_drops, CAST(w AS BIGINT)), 0L)) END"
    joined = joined.select("_row", "_drops", lines.alias("_lines")).withColumn("_bits", F.expr(dense))
    joined = joined.withColumn("_kept", F.expr("CASE WHEN _bits IS NULL THEN _lines ELSE filter(_lines, (x, i) -> getbit(_bits[i div 64], i % 64) = 0) END"))
    out = [F.array_join("_kept", "\n").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return joined.select(*out, F.size("_lines").cast("long").alias("_n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("_n_dropped"))
