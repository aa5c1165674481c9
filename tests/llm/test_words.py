"""Word tables, window hashes and Elias-Fano sequences against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sparktab.llm.succinct import EliasFano
from sparktab.llm.words import flat, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x0c\r\x1c\x85 中", max_size=30)), min_size=1, max_size=8)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_the_runs_between_ascii_white_space(texts):
    raw, offs = flat(pa.array(texts, pa.string()))
    words = words_of(raw, offs)
    data = raw.tobytes()
    seen = {}
    for i, text in enumerate(texts):
        own = [data[a:b].decode() for a, b in zip(words.starts[words.first[i]:words.first[i + 1]], words.ends[words.first[i]:words.first[i + 1]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for word, h in zip(own, words.hashes[words.first[i]:words.first[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_folding_joins_cases_of_ascii_letters_only():
    a = words_of(*flat(pa.array(["Ab É", "aB é"])), fold=True)
    assert a.hashes[0] == a.hashes[2] and a.hashes[1] != a.hashes[3]


def test_sliced_columns_and_chunks():
    column = pa.chunked_array([pa.array(["x", "a b", None]), pa.array(["c"])]).slice(1)
    raw, offs = flat(column)
    assert raw.tobytes() == b"a bc" and offs.tolist() == [0, 3, 3, 4]


@given(st.lists(st.integers(0, 10**6), max_size=200), st.lists(st.integers(0, 10**6 + 5), max_size=50))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values, asked):
    values, asked = np.sort(np.array(values, np.int64)), np.array(asked, np.int64)
    sequence = EliasFano.build(values)
    assert (sequence.get(np.arange(len(values))) == values).all()
    place, value = sequence.successor(asked)
    expected = np.searchsorted(values, asked)
    assert (place == expected).all()
    assert [int(v) for v in value] == [int(values[p]) if p < len(values) else -1 for p in expected]


@pytest.mark.parametrize("values", [np.arange(5000), np.concatenate([np.arange(3000), 10**9 + np.arange(0, 9000, 7)]), np.zeros(4, np.int64)])
def test_elias_fano_dense_runs(values):
    sequence = EliasFano.build(values)
    asked = np.concatenate([values, values + 1, [0]])
    assert (sequence.successor(asked)[0] == np.searchsorted(values, asked)).all()
