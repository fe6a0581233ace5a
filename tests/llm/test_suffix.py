import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.suffix import byte_suffix_array, common_prefixes, suffix_array


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4))
def test_against_sorted_suffixes(texts):
    s = np.array([x for t in texts for x in t], np.int64)
    text = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
    n = len(s)
    suffix = [(text[i], tuple(s[i : np.searchsorted(text, text[i], "right")])) for i in range(n)]
    sa, _ = suffix_array(s, text)
    assert [suffix[i] for i in sa] == sorted(suffix)
    lcp = common_prefixes(s, text, sa)
    for k in range(1, n):
        a, b = suffix[sa[k - 1]], suffix[sa[k]]
        assert lcp[k] == (_common(a[1], b[1]) if a[0] == b[0] else 0)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = (s + 65).astype(np.uint8)
    sa, tied = byte_suffix_array(off, data, 5)
    whole = [x[1] for x in suffix]
    assert [whole[i] for i in sa] == sorted(whole)
    lcp = common_prefixes(data, text, sa, tied)
    for k in range(1, n):
        real = _common(whole[sa[k - 1]], whole[sa[k]])
        assert (real < 5 or tied[k]) and (not tied[k] or lcp[k] == real)


def test_periodic_text():
    s = np.zeros(5000, np.int64)
    sa, _ = suffix_array(s, s)
    assert list(sa) == list(range(4999, -1, -1))
    assert list(common_prefixes(s, s, sa)) == list(range(5000))
