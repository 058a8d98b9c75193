"""Quality rules, line first, in DataFrame functions only.

Each line is judged. Punctuation: too many symbols, too much or repeated
punctuation, a short line without a sentence end where most lines have one, and
lines that break off in dots, or begin with a bullet, where so many do that the
text is a list of teasers. Navigation: menus by separators, and runs of
neighbouring short lines. Boilerplate: stock phrases. Blank lines end a run and
always pass. Failing lines go; a document that loses too much of its text is
rejected, and so is one that fails the base rules on its length and repetition.

Characters are classified in whole texts, which are then cut at \\n, so that what
is done for each line looks at its short extracts: long texts cost what as many
short ones do, and none is cut. One row must fit a task, nothing else is gathered.

Null text counts as empty. Empty text has no words and fails the base rule.
Repeated rows are judged one by one, ties in no rule depend on order; other
columns are neither read nor returned unless named in ``keep``, which must not
have names of measures or names that begin with an underscore. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, settled

#: Phrases of pages' boilerplate, in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use cookies",
)
#: Menu separators anywhere, and those that count between spaces only, each with its sign.
SEPARATORS = "|·•»›→"
SPACED_SEPARATORS = (" / ", " > ", " - ", " :: ", " ~ ")
#: White space of the word rule but for \\n; letters, marks and digits.
SPACE = r"\x20\x09\x0B-\x0D"
_SYMBOLS = "#*$%&|<>"
_PLAIN = r"a-zA-Z0-9\p{L}\p{M}\p{N}"
#: What ends a sentence, and what may follow it; white space at the end of a line counts for neither.
SENTENCE_ENDS, CLOSERS = ".!?:;…。！？؟।", "\"'”’»)]"
TRAILING = "\x20\x09\x0A\x0B\x0C\x0D"
#: What a line that breaks off ends with, and what a bulleted line begins with.
DOTS = ("...", "…")
#: How many characters at the end of a line are looked at first, patterns of what they may end with, and of an end that they don't show.
TAIL = 8
ENDED = rf"[{SENTENCE_ENDS}][\"'”’»)\]]*[\x20\x09-\x0D]*$"
BROKEN = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
FILLED = rf"[\"'”’»)\]\x20\x09-\x0D]{{{TAIL - 2}}}$"
BULLETS = r"^[\x20\x09-\x0D]*[-*•‣◦▪●·–—]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    most_repeat_percent: int = 30
    #: A line fails if more than this share of its characters other than spaces are symbols.
    most_symbol_share: float = 0.10
    #: A line fails if this share of its words, and at least three, are menu separators.
    least_menu_share: float = 0.25
    #: A line fails if more than this share of its characters other than spaces, and at least three, are neither letters, marks nor digits.
    most_punctuation_share: float = 0.40
    #: A line fails if one such character follows itself so often.
    punctuation_run: int = 5
    #: Where this share of the lines that are not blank ends a sentence, a line of up to so many words that ends none fails.
    least_ended_share: float = 0.50
    most_unended_words: int = 4
    #: Lines of up to so many words without a sentence end fail in runs of at least ``menu_run`` neighbours.
    most_menu_words: int = 3
    menu_run: int = 5
    #: Lines that break off in dots go where this share of the lines that are not blank does, and so do bulleted lines.
    least_dotted_share: float = 0.30
    least_bulleted_share: float = 0.90
    #: Stock phrases count in lines of up to this many words.
    most_boilerplate_words: int = 30
    #: A document is rejected if it loses more than this share of its characters other than spaces.
    most_lost_share: float = 0.40


def _repeated(df: DataFrame, words: Column, carried: list[str], window: int) -> DataFrame:
    """``df`` with n_words and n_repeat_words, the words in windows found twice or more; of other columns only ``carried``.

    Windows are told apart by 64-bit hashes within one document, of two halves
    each, and these of two quarters. Sorting positions by hash happens only in
    documents that have a repeated window. Each step drops what the next ones
    don't need, for a row is written anew after each.
    """
    df = df.select(*carried, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    df, carried, reach = df.select(*carried, F.size("_h").cast("long").alias("n_words"), "_h"), [*carried, "n_words"], 1
    while reach < window:
        # The last step's halves overlap where the window is no power of two.
        by = min(reach, window - reach)
        pairs = f"zip_with(_h, slice(_h, {by + 1}, greatest(0, size(_h) - {by})), (a, b) -> xxhash64(a, b))"
        reach += by
        # Without a half that occurs twice no window does.
        df = df.select(*carried, F.expr(f"CASE WHEN size(array_distinct(_h)) < size(_h) THEN {pairs} ELSE array() END" if reach == window else pairs).alias("_h"))
    for step in (
        f"slice(_h, 1, greatest(0, size(_h) - {window - 1}))",
        "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i + 1 AS i))) ELSE array() END",
        """CASE WHEN size(_h) = 0 THEN array() ELSE sort_array(transform(
             filter(sequence(0, size(_h) - 1), j -> (j > 0 AND _h[j].h = _h[greatest(j - 1, 0)].h) OR (j < size(_h) - 1 AND _h[j].h = _h[least(j + 1, size(_h) - 1)].h)),
             j -> _h[j].i)) END""",
    ):
        df = df.select(*carried, F.expr(step).alias("_h"))
    return df.select(*carried, F.expr(f"aggregate(_h, struct(0L AS n, 0 AS end), (x, p) -> struct(x.n + p + {window} - greatest(x.end, p) AS n, p + {window} AS end), x -> x.n)").alias("n_repeat_words"))


def _prepared(docs: DataFrame, keep: tuple[str, ...], window: int) -> DataFrame:
    """Base measures, and by line: _lines, _solid (its characters other than spaces), _count (its words) and _marks (its characters that are neither letters, digits nor spaces)."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select(*keep, "_text", F.transform(F.split("_text", "\n"), lambda x: F.array_remove(F.split(x, WORD_SPLIT), "")).alias("_parts"))
    df = df.select(*keep, "_text", F.transform("_parts", F.size).alias("_count"), F.flatten("_parts").alias("_words"))
    df = _repeated(df, F.col("_words"), [*keep, "_text", "_count"], window)
    df = df.select(
        *keep,
        "n_words",
        "n_repeat_words",
        "_count",
        F.split("_text", "\n").alias("_lines"),
        F.transform(F.split(F.regexp_replace("_text", f"[{SPACE}]+", ""), "\n"), F.length).alias("_solid"),
        F.regexp_replace("_text", f"[{_PLAIN}{SPACE}]+", "").alias("_other"),
        _has_phrase(F.lower("_text")).alias("_stock"),
    )
    df = df.withColumn("_filled", F.filter("_lines", lambda x, i: F.col("_solid")[i] > 0))
    return settled(df.select(
        *keep,
        "n_words",
        F.aggregate("_solid", F.lit(0).cast("long"), lambda n, k: n + k).alias("word_chars"),
        (F.length("_other") - F.length(F.regexp_replace("_other", f"[{_SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "_lines",
        "_solid",
        "_count",
        F.split("_other", "\n").alias("_marks"),
        "_stock",
    ))


def _has_phrase(low: Column) -> Column:
    """Whether a stock phrase begins a word; its first letter is looked at first, so that few places are tried."""
    initials = "".join(sorted({phrase[0] for phrase in BOILERPLATE}))
    return F.rlike(low, F.lit(rf"(?<![a-z0-9_])(?=[{initials}])(?:{'|'.join(BOILERPLATE)})"))


def base_measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = 8) -> DataFrame:
    """Counts over the whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return _prepared(docs, keep, window).select(*keep, *MEASURES)


def _judged(rules: QualityRules) -> Column:
    """For each line: m (b blank, e ends a sentence, m menu entry, u short without an end, o other), bad (fails by itself), dotted, bulleted."""

    def one(line: Column, i: Column) -> Column:
        marks, words, solid = F.col("_marks")[i], F.col("_count")[i], F.col("_solid")[i]
        n = F.length(marks)
        symbols = n - F.length(F.regexp_replace(marks, f"[{_SYMBOLS}]+", ""))
        bars = n - F.length(F.regexp_replace(marks, f"[{SEPARATORS}]+", ""))
        for separator in SPACED_SEPARATORS:
            times = (F.length(line) - F.length(F.replace(line, F.lit(separator), F.lit("")))) / len(separator)
            bars = bars + F.when(marks.contains(separator.strip()), times).otherwise(0)
        menu = (n >= 3) & (bars >= F.greatest(F.lit(3), words * rules.least_menu_share))
        much = (n >= 3) & (n > solid * rules.most_punctuation_share)
        run = (n >= rules.punctuation_run) & line.rlike(rf"([^{_PLAIN}{SPACE}])\1{{{rules.punctuation_run - 1}}}")
        stock = F.col("_stock") & (words <= rules.most_boilerplate_words) & _has_phrase(F.lower(line))
        bad = ((n > solid * rules.most_symbol_share) & (symbols > solid * rules.most_symbol_share)) | much | run | menu | stock
        # Of a line without marks nothing is looked at.
        bad = ((n > 0) & bad) | stock
        # The last characters tell, unless spaces and closing marks fill them: such lines are trimmed, at any length.
        tail = F.right(line, F.lit(TAIL))
        far = F.rlike(tail, F.lit(FILLED))
        end = F.rtrim(line, F.lit(TRAILING))
        last = F.right(F.rtrim(end, F.lit(CLOSERS)), F.lit(1))
        ended = F.when(far, (last != "") & F.contains(F.lit(SENTENCE_ENDS), last)).otherwise(F.rlike(tail, F.lit(ENDED)))
        letter = F.when(words == 0, "b").when((n > 0) & ended, "e").when(words <= rules.most_menu_words, "m").when(words <= rules.most_unended_words, "u").otherwise("o")
        broken = F.when(far, end.endswith(DOTS[0]) | end.endswith(DOTS[1])).otherwise(F.rlike(tail, F.lit(BROKEN)))
        dotted, bulleted = (n > 0) & broken, (n > 0) & F.rlike(line, F.lit(BULLETS))
        return F.struct(letter.alias("m"), ((words > 0) & bad).alias("bad"), dotted.alias("dotted"), bulleted.alias("bulleted"))

    return F.transform("_lines", one)


def _in_run(run: int) -> str:
    """A pattern of the letter m with so many others around it that they make a run."""
    return "|".join("".join([f"(?<=m{{{k}}})" if k else "", "m", f"(?=m{{{run - 1 - k}}})" if k < run - 1 else ""]) for k in range(run))


def clean_lines(docs: DataFrame, rules: QualityRules = QualityRules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures, ``cleaned`` (the lines that pass, joined by \\n), ``lost_share``, base_failed and kept."""
    df = settled(_prepared(docs, keep, rules.window).withColumn("_judged", _judged(rules)))
    filled = F.greatest(F.lit(1), F.size(F.filter("_count", lambda n: n > 0)))
    many = lambda test, least: F.size(F.filter("_judged", test)) >= least * filled
    letters = F.array_join(F.transform("_judged", lambda x: x["m"]), "")
    df = df.withColumns({
        "_letters": F.split(F.regexp_replace(letters, _in_run(rules.menu_run), "x"), ""),
        "_ended": many(lambda x: x["m"] == "e", rules.least_ended_share),
        "_dotted": many(lambda x: x["dotted"], rules.least_dotted_share),
        "_bulleted": many(lambda x: x["bulleted"], rules.least_bulleted_share),
    })

    def passes(x: Column, i: Column) -> Column:
        letter = F.col("_letters")[i]
        short = (letter == "x") | (F.col("_ended") & letter.isin("m", "u"))
        return ~(x["bad"] | short | (F.col("_dotted") & x["dotted"]) | (F.col("_bulleted") & x["bulleted"]))

    df = settled(df.withColumn("_passes", F.transform("_judged", passes)).drop("_judged", "_letters"))
    left = F.aggregate(F.zip_with("_solid", "_passes", lambda n, ok: F.when(ok, n).otherwise(0)), F.lit(0).cast("long"), lambda n, k: n + k)
    lost = F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    cleaned = F.array_join(F.filter("_lines", lambda line, i: F.col("_passes")[i]), "\n")
    df = df.select(*keep, *MEASURES, cleaned.alias("cleaned"), lost.alias("lost_share"), failed.alias("base_failed"))
    return settled(df).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.most_lost_share))
