import pytest
from hypothesis import given
from hypothesis import strategies as st

from weft.operators.drops import common_column_blocks, kept_blocks, signature_blocks, steepest_drop

L7 = [0.75, 0.65, 0.60, 0.49, 0.48, 0.45, 0.40]
L10 = [*L7, 0.35, 0.30, 0.25]


@pytest.mark.parametrize(
    ("values", "least", "full", "ignore", "start", "want"),
    [
        ([], 0.5, True, True, 0, 0), (L7, 0.5, True, True, 0, 7), (L7, 0.5, False, True, 0, 3), (L7, 0.5, False, False, 0, 7), (L7, 0.8, True, True, 0, 0), (L10, 0.5, True, True, 0, 3),
        ([*L10[:3], 0.55, *L10[3:]], 0.5, True, True, 0, 1), ([0.75, 0.65, 0.60, 0.40], 0.5, False, True, 0, 3), ([0.75, 0.65, 0.60, 0.40], 0.5, False, False, 0, 4), ([0.75], 0.8, True, True, 0, 0), ([0.75], 0.6, True, True, 0, 1),
        (L7, 0.5, False, True, 3, 6), (L7, 0.5, False, True, 6, 7), (L7, 0.5, False, True, 7, 0),
    ],
)
def test_vectors(values, least, full, ignore, start, want):
    assert steepest_drop(values, start, least, full, ignore)[0] == want


A = [0.8, 0.7, 0.5, 0.45]
B = [0.31, 0.30, 0.20, 0.20, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05, 0.015, 0.010, 0.005, 0.001]
C = [0.91, 0.90, 0.80, 0.80, 0.75, 0.73, 0.71, 0.69, 0.67, 0.65, 0.615, 0.61, 0.605, 0.601]


@pytest.mark.parametrize(
    ("values", "full", "ignore", "minor", "want"),
    [(A, False, True, False, [2, 1, 1]), (A, True, True, False, [4]), (A, True, False, False, [4]), (A, False, False, False, [4]), *[(B, f, i, True, [2, 2, 10]) for f in (True, False) for i in (True, False)], (C, False, True, True, [2, 2, 10])],
)
def test_blocks(values, full, ignore, minor, want):
    assert [j - i for i, j in signature_blocks(values, 0.0, full, ignore, minor)] == want


@given(st.lists(st.floats(0.01, 1.0), max_size=40), st.booleans(), st.booleans(), st.booleans())
def test_blocks_part_the_list(values, full, ignore, minor):
    values = sorted(values, reverse=True)
    at = 0
    for i, j in signature_blocks(values, 0.0, full, ignore, minor):
        assert i == at < j <= len(values)
        at = j


def test_kept():
    assert kept_blocks([1, 5, 5], "LIBERAL") == 1
    assert kept_blocks([5, 1], "LIBERAL") == 1
    assert kept_blocks([1, 2, 3], "IGNORE-LAST") == 2
    assert common_column_blocks({1, 2}, [[{1}, {1, 3}], [{2}, {3}]]) == 1
    assert common_column_blocks({1}, [[{2}]]) == 0
