"""Licence notices broken over lines, and families that share most of their words."""

import textwrap

from halocline.llm import licenses

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CASES = [
    (1, "a few words before\n\n" + textwrap.fill(GPL, 70) + "\n\nwords after it", "gpl"),
    (2, textwrap.fill(MIT, 70), "mit"),
    (3, "\n".join("# " + x for x in textwrap.wrap(BSD, 70)), "bsd"),
    (4, textwrap.fill(GPL.replace("GNU General", "GNU Affero General"), 60), "agpl"),
    (5, textwrap.fill(GPL.replace("GNU General", "GNU Lesser General").replace("program", "library"), 70), "lgpl"),
    (6, "Released under the ISC License", "isc"),
    (7, "Released under the MIT License", "mit"),
    (8, "we use the public road\nand any person\nmay go free of charge\nunder the terms of this house", ""),
    (9, None, ""),
]


def test_wrapped_headers_and_close_families(spark):
    plain = [(100 + i, f"the river number {i} runs to the sea\nplain words about rivers and use of the land in any form") for i in range(40)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([c[:2] for c in CASES] + plain, "doc_id long, text string")).collect()}
    assert {k: got[k].families for k, *_ in CASES} == {k: f for k, _, f in CASES}
    assert not any(got[k].families for k, _ in plain)
    assert got[1].n_license_paragraphs >= 3 and got[1].n_paragraphs == CASES[0][1].count("\n") + 1


def test_words_of_a_notice_in_another_order_are_none(spark):
    words = MIT.split()
    docs = [(1, " ".join(sorted(words))), (2, MIT), (3, None), (4, "")] + [(100 + i, f"plain words about rivers and use of the land in any form {i}") for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    scanner = licenses.fit(table)
    assert scanner.slope > 0
    got = {r.doc_id: r for r in licenses.scan(table, scanner).collect()}
    assert (got[1].families, got[2].families, got[3].families, got[4].families) == ("", "mit", "", "")
    assert 0.5 <= got[2].probability <= 1
    assert licenses.scan(table.limit(0), scanner).count() == 0


def test_calibration_with_one_kind_only_keeps_margins(spark):
    held = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "_margin double, label double")
    assert licenses._calibration(held) == (1.0, 0.0)


def test_notices_wrapped_at_any_width_up_to_blank_lines_and_ends(spark):
    """Each template at 12 to 100 columns, before a blank line and at the end of the text."""
    plain = [(9000 + i, f"the river number {i} runs to the sea\nplain words about rivers and use of the land in any form") for i in range(40)]
    docs, want = list(plain), {}
    for k, (family, text) in enumerate(licenses.TEMPLATES):
        for n, width in enumerate((12, 24, 40, 72, 100)):
            own = "\n".join(textwrap.wrap(text.replace("{v}", "2"), width, break_long_words=False, break_on_hyphens=False))
            if own.count("\n") + 1 > max(licenses.RUN_LINES):
                continue
            name = 100 * k + 2 * n
            docs += [(name, f"Intro words of a page\n\n{own}\n\nand the page goes on with other words"), (name + 1, f"Intro words of a page\n\n{own}")]
            want |= {name: family, name + 1: family}
    scanner = licenses.fit(spark.createDataFrame(plain, "doc_id long, text string"))
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), scanner).collect()}
    missed = [(k, f, got[k]) for k, f in want.items() if got[k] != f]
    assert len(want) > 250 and len(missed) <= 0.02 * len(want), missed
    assert not any(got[k] for k, _ in plain)
