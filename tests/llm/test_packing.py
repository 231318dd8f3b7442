"""Tokens, cuts and pieces: exact round trips and a plain search for the best cuts."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salesloom.llm import packing, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_TOKENIZER))
TOKENIZER.encode_special_tokens = True
SOME = "aB éÉΣ中́\U0001f600 \t\n\x0b\x85\xa0 <|endoftext|>'s 12.!?###"


def plain(text, last=2):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, last]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=SOME, max_size=40), st.text(max_size=40)), max_size=6))
def test_tokens_of_words_are_tokens_of_texts(texts):
    encoder = tokens.encoder()
    ids, bounds, ends = encoder.encode(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain(t) for t in texts]
    ids, bounds, _ = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain(t)[:-1] for t in texts]


def test_memory_is_bounded(monkeypatch, document_rows):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    small = tokens.WordEncoder(tokens.WORD_TOKENIZER)
    for row in document_rows[:10]:
        ids, _, ends = small.encode(pa.array([row[1]]), 2)
        assert ids.tolist() == plain(row[1])
        words = row[1].split()
        want = [len(plain(" ".join(words[: i + 1]))) - 1 for i, w in enumerate(words) if w[-1] in ".!?"]
        assert ends.tolist() == want


def cheapest(places, costs, window):
    """Least cost over all ways to cut, by plain dynamic programming."""
    at, price = [0, *places], [0, *costs]
    best = [0] + [10**9] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            if at[i] - at[j] <= window:
                best[i] = min(best[i], best[j] + window - (at[i] - at[j]) + price[i])
    end = at[-1]
    return min(
        best[j] + packing.end_cost(end - at[j], window) for j in range(len(at) - 1) if end - at[j] <= window
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 1, 5])), min_size=1, max_size=40))
def test_cuts_cost_least(steps):
    window = 16
    places = np.cumsum([s for s, _ in steps])
    costs = np.array([c for _, c in steps])
    costs[-1] = 0
    cuts = packing.best_cuts(places, costs, window)
    assert cuts == sorted(set(cuts)) and cuts[-1] == places[-1]
    price = dict(zip(places.tolist(), costs.tolist(), strict=True))
    total, last = 0, 0
    for k, cut in enumerate(cuts):
        assert 0 < cut - last <= window
        if cut in price:
            total += price[cut] if k < len(cuts) - 1 else 0
            total += window - (cut - last) if k < len(cuts) - 1 else 0
        last = cut
    want = cheapest(places.tolist(), costs.tolist(), window)
    plain_end = [c for c in cuts[:-1] if c not in price]
    if not plain_end:
        last_size = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
        assert total + packing.end_cost(last_size, window) == want


def test_layers_of_cuts_equal_the_queue(monkeypatch):
    rng = np.random.default_rng(7)
    for window, most, step in ((64, 8, 16), (64, 30, 40), (4096, 8, 16), (16, 5, 16)):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, step, 5000))])
        price = np.concatenate([[0], rng.integers(0, most + 1, 5000)])
        found = packing._by_layers(at, price, window)
        want = packing._by_queue(at.tolist(), price.tolist(), window)
        assert found is None or np.array_equal(found, want)
    monkeypatch.setattr(packing, "_by_queue", None)  # the usual windows need no queue
    bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 2000, 1000))])
    cuts = packing.best_cuts(*packing.offered_cuts(bounds, bounds[1:] - 1))
    assert cuts[-1] == bounds[-1] and max(np.diff([0, *cuts])) <= packing.WINDOW


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_round_trip(request, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, ids.tolist()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    want = defaultdict(list)
    for d in docs.collect():
        ids = plain(d.text)
        want[(d.doc_id, len(ids))].append(ids)
    assert set(want) == set(by_doc)
    for key, texts in want.items():
        if len(texts) == 1:
            joined = [i for _, part in sorted(by_doc[key]) for i in part]
            assert joined == texts[0]
        else:
            assert sum(len(p) for _, p in by_doc[key]) == sum(map(len, texts))


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    sizes = defaultdict(int)
    for r in packing.pack(docs).select("sequence_id", "length").collect():
        sizes[r.sequence_id] += r.length
    waste = sum(packing.padding(n) for n in sizes.values())
    assert waste < 0.005 * sum(sizes.values())


def test_empty_table(documents):
    assert packing.pack(documents.limit(0)).count() == 0
