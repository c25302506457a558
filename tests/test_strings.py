import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import fold

WORDS = st.text("ab é", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_common_subsequence(a, b):
    assert fold.common_subsequence(a, b) == lcs(a, b)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_ratios_are_symmetric_and_within_bounds(a, b):
    for name, f in fold.RATIOS.items():
        assert 0 <= f(a, b) <= 1
        if name not in ("partial_ratio", "jaro_winkler"):
            assert f(a, b) == pytest.approx(f(b, a))


@pytest.mark.parametrize(
    ("name", "a", "b", "value"),
    [
        ("indel_ratio", "", "", 1.0), ("indel_ratio", "abcd", "", 0.0), ("indel_ratio", "this is a test", "this is a test!", 28 / 29), ("token_sort_ratio", "b a", "a b", 1.0),
        ("token_set_ratio", "", "a", 0.0), ("token_set_ratio", "new york mets", "mets new york new york", 1.0), ("token_set_ratio", "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
        ("partial_ratio", "abc", "xxabcxx", 1.0), ("partial_ratio", "", "", 1.0), ("partial_ratio", "", "a", 0.0), ("jaro_winkler", "martha", "marhta", 0.9611111), ("jaro_winkler", "dixon", "dicksonx", 0.8133333), ("jaro_winkler", "", "a", 0.0),
    ],
)
def test_known_values(name, a, b, value):
    assert fold.RATIOS[name](a, b) == pytest.approx(value, abs=1e-6)


def test_fold():
    assert [fold.fold(x) for x in (None, "", "Ünïted ﬁne ß", "ABC")] == ["", "", "united fine ß", "abc"]
