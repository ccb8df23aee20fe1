"""Words are compared once, and letter by letter only where that can matter."""

import numpy as np
import pytest

from crateflow.llm import name_variants


@pytest.fixture
def compared(monkeypatch):
    seen, edits = [], name_variants.edits
    monkeypatch.setattr(name_variants, "edits", lambda a, b, most: seen.append((a, b)) or edits(a, b, most))
    return seen


def test_two_words_are_compared_once(compared):
    counts, met = np.zeros(name_variants.SLOTS, np.int64), {}
    first = name_variants.score(["marlena", "dolvik"], ["marlene", "dolvik"], counts, 100, met)
    n = len(compared)
    assert n and first > name_variants.LEAST_SCORE
    assert name_variants.score(["marlena", "dolvik"], ["marlene", "dolvik"], counts, 100, met) == first
    assert len(compared) == n


def test_known_words_are_not_compared_by_letters(compared):
    counts = np.zeros(name_variants.SLOTS, np.int64)
    counts[[name_variants.slot("marlena"), name_variants.slot("marlene")]] = 50
    assert name_variants.inner("marlena", "marlene", counts) == 0.0
    assert not compared


@pytest.mark.parametrize(("a", "b", "most", "want"), [("marlena", "marlene", 2, 1), ("marlena", "malrena", 1, 1), ("abcd", "efgh", 2, 3), ("aab", "abb", 1, 1), ("abc", "xbcy", 1, 2), ("", "ab", 2, 2)])
def test_edits(a, b, most, want):
    assert name_variants.edits(a, b, most) == want
