import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakekit.llm.suffixes import Strings, common_prefixes, suffix_array


def build(parts):
    return Strings(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=8))
def test_array_and_prefixes_match_plain_sorting(parts):
    strings = build(parts)
    array = suffix_array(strings)
    texts = [strings.buf[i : i + strings.left[i]].tobytes() for i in array]
    assert len(array) == sum(map(len, parts)) == len(set(array.tolist()))
    assert texts == sorted(texts)

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert common_prefixes(strings, array, 13).tolist() == [min(13, shared(a, b)) for a, b in zip(texts, texts[1:])]


@pytest.mark.parametrize("parts", [[b"a" * 300], [b"ab" * 90, b"ab" * 90, b"a"], [b"\0\0", b"\0", b"\0\0\0"], [b"\xff" * 20, b"\xff"]])
def test_runs_and_end_bytes(parts):
    strings = build(parts)
    texts = [strings.buf[i : i + strings.left[i]].tobytes() for i in suffix_array(strings)]
    assert texts == sorted(texts)
