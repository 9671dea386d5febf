"""The search kernel against definitions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.operators.search import allowed_edits, disjoint, edit_distance, end_distances, find_all, find_disjoint

bases = st.text("ACGT", max_size=20)


@settings(max_examples=150, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=8), bases)
def test_end_distances_are_the_least_over_all_starts(pattern, text):
    got = end_distances(pattern, text)
    assert got == [min(edit_distance(pattern, text[s:e]) for s in range(e + 1)) for e in range(len(text) + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=8), bases, st.integers(0, 3))
def test_hits_span_what_they_say(pattern, text, k):
    for start, end, d in find_all(pattern, text, k):
        assert edit_distance(pattern, text[start:end]) == d <= k


@settings(max_examples=100, deadline=None)
@given(st.text("AC", min_size=1, max_size=4), st.text("AC", max_size=20), st.integers(0, 2))
def test_disjoint_hits_dont_overlap_and_best_come_first(pattern, text, k):
    hits = find_disjoint(pattern, text, k)
    assert [h[2] for h in hits] == sorted(h[2] for h in hits)
    assert all(a[0] >= b[1] or a[1] <= b[0] for i, a in enumerate(hits) for b in hits[:i])


def test_patterns_longer_than_a_machine_word():
    pattern = "ACGT" * 40
    text = "TT" + pattern[:80] + "A" + pattern[80:] + "GG"
    assert min(end_distances(pattern, text)) == 1


def test_exact_hits_without_overlap():
    assert [h[:2] for h in find_disjoint("AA", "AAAAA", 0)] == [(0, 2), (2, 4)]
    assert disjoint([(0, 3, 1), (2, 4, 0)]) == [(2, 4, 0)]


def test_allowed_edits_floor_in_32_bits():
    assert allowed_edits(100, 0.29) == 29 == int(np.floor(np.float32(100) * np.float32(0.29)))
    assert allowed_edits(8, 0.2) == 1
