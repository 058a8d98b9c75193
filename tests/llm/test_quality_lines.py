"""Line rules: punctuation and navigation of every kind go, prose stays."""

from halocline.llm import quality

PROSE = "\n".join(f"The river number {i} runs down to the sea, past the old town and its garden." for i in range(4))
PLAIN = "\n".join(f"the river number {i} runs down to the sea past the old town and its garden" for i in range(4))
GO = {
    1: ".....",
    2: "----- -----",
    3: "wait !!!!!! what is this about",
    4: "Home / News / About / Contact / Shop",
    5: "Home > News > About > Contact > Shop",
    6: "Home · News · About · Contact · Shop",
    7: "Home » News » About » Contact » Shop",
    8: "Home\nNews\nAbout us\nContact\nShop\nHelp",
    9: "( ) : ; ' , - a",
}


def test_lines_that_go(spark):
    rows = [(k, f"{PLAIN}\n{x}\n{PLAIN.upper()}") for k, x in GO.items()] + [(50, f"{PROSE}\nRead more here\n{PROSE.upper()}"), (51, PLAIN), (52, PROSE), (53, f"{PLAIN}\n\nHome\nNews\n\n{PLAIN.upper()}"), (54, "")]
    got = {r.doc_id: r.cleaned for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in GO} == {k: f"{PLAIN}\n{PLAIN.upper()}" for k in GO}
    assert got[50] == f"{PROSE}\n{PROSE.upper()}"
    assert {k: got[k] for k in (51, 52, 53, 54)} == {k: t for k, t in rows if k in (51, 52, 53, 54)}


def test_pages_of_menus_are_rejected(spark):
    prose = "\n".join(" ".join(f"word{20 * i + k}" for k in range(15)) for i in range(4))
    menus = "\n".join(f"Entry {i}" for i in range(60)) + "\n" + prose
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.clean_lines(spark.createDataFrame([(1, menus), (2, prose)], "doc_id long, text string")).collect()}
    assert got == {1: (False, False), 2: (False, True)}


FAR = ")\"'»]" * 3


def test_sentence_ends_before_any_number_of_spaces_and_closing_marks(spark):
    ended = "\n".join(f"{x}{FAR}{' ' * 30}\t" for x in PROSE.split("\n"))
    broken = "\n".join(f"{x.rstrip('.')} ...{' ' * 40}" for x in PROSE.split("\n"))
    rows = [(1, f"{ended}\nRead more here\n{ended.upper()}"), (2, broken)]
    got = {r.doc_id: r.cleaned for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Read more here" not in got[1] and got[1].count("\n") == 7
    assert got[2] == ""
