"""Banded alignment against plain edit distance, and texts that repeat themselves."""

import resource

import numpy as np

from halocline.llm import decontaminate

RNG = np.random.default_rng(41)
LETTERS = "abcdefgh "


def _least_edits(item: str, text: str) -> int:
    """Edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def _random(n: int) -> str:
    return " ".join("".join(RNG.choice(list(LETTERS), n)).split())


def _edited(text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        k, kind = int(RNG.integers(0, len(out))), RNG.integers(0, 3)
        if kind == 0:
            out[k] = "x"
        elif kind == 1:
            out.insert(k, "y")
        else:
            del out[k]
    return "".join(out)


def test_passages_are_those_of_plain_edit_distance():
    n_found = 0
    for _ in range(120):
        item = decontaminate.characters(_random(int(RNG.integers(12, 90)))).view(np.uint32)
        item = "".join(map(chr, item))
        budget = int(0.08 * len(item))
        text = f"{_random(30)} {_edited(item, int(RNG.integers(0, budget + 3)))} {_random(30)}"
        whole = "".join(map(chr, decontaminate.characters(text)))
        found = decontaminate.find(text, decontaminate.index_items([(7, item)]))
        least = _least_edits(item, whole)
        assert bool(found) == (least <= budget), (item, whole)
        n_found += bool(found)
        if found:
            assert min(f[3] for f in found) == least
            for _, a, z, d in found:
                assert _least_edits(item, whole[a:z]) <= d <= budget
    assert 30 < n_found < 115


def test_passages_at_both_ends_of_a_text():
    item = "the quick brown fox jumps over the lazy dog"
    items = decontaminate.index_items([(1, item)])
    assert [f[1:] for f in decontaminate.find(item, items)] == [(0, len(item), 0)]
    assert [f[1:] for f in decontaminate.find(f"{item} and {item}", items)] == [(0, 43, 0), (48, 91, 0)]
    assert decontaminate.find(item[2:], items)[0][3] == 2


def test_long_periodic_texts_stay_small():
    items = decontaminate.index_items([(1, "ab" * 100), (2, _random(300))])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = decontaminate.find("ab" * 500_000, items)
    assert len(found) > 4800 and all(z - a == 200 and d == 0 for _, a, z, d in found)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024
