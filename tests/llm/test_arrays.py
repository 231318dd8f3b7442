"""Words, hashes and shingles against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from salesloom.llm import arrays

ALPHABET = "aB \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 é中\U0001f600."
texts = st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(values):
    flat, starts = arrays.words(pa.array(values, pa.string()))
    flat = flat.to_pylist()
    for i, text in enumerate(values):
        assert flat[starts[i] : starts[i + 1]] == re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=100, deadline=None)
@given(texts)
def test_shingles_are_equal_where_words_are(values):
    flat, starts = arrays.words(pa.array(values, pa.string()), lower=True)
    runs, begins = arrays.shingles(arrays.word_hashes(flat), starts, 3)
    plain = flat.to_pylist()
    by_hash, by_words = {}, {}
    for i in range(len(values)):
        own = plain[starts[i] : starts[i + 1]]
        want = [tuple(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
        got = runs[begins[i] : begins[i + 1]].tolist()
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert by_hash.setdefault(h, w) == w and by_words.setdefault(w, h) == h


def test_word_hash_does_not_depend_on_the_place():
    a = arrays.word_hashes(pa.array(["x", "some", "wordé"]))
    b = arrays.word_hashes(pa.array(["wordé", "padding", "some"]).slice(0, 3))
    assert a[1] == b[2] and a[2] == b[0]
    assert len(np.unique(arrays.word_hashes(pa.array([f"t{i}" for i in range(200_000)])))) == 200_000


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array(["a" * 10, None, "b" * 500, "", "c", "d" * 90])], ["k", "text"]
    )
    parts = list(arrays.sliced(batch, "text", most=100))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6)) and len(parts) > 1
    assert list(arrays.sliced(batch.slice(0, 0), "text")) == []
