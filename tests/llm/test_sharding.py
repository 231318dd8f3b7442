"""Packing against a plain search over all bins, and the promises of the shards."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesloom.llm import sharding


def plain_best_fit(sizes, capacity):
    left, places = [], []
    for size in sizes:
        fits = [(free, b) for b, free in enumerate(left) if free >= size]
        if fits:
            b = min(fits)[1]
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= size
        places.append(b)
    return places


sizes_list = st.lists(st.integers(1, 50), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(sizes_list)
def test_best_fit_takes_the_tightest_bin(sizes):
    falling = np.array(sorted(sizes, reverse=True))
    assert sharding.best_fit(falling, 50).tolist() == plain_best_fit(falling.tolist(), 50)
    shuffled = np.array(sizes)
    places = sharding.fewest_bins(shuffled, 50)
    assert np.bincount(places, shuffled).max() <= 50


@settings(max_examples=100, deadline=None)
@given(sizes_list, st.integers(1, 8))
def test_even_bins(sizes, bins):
    sizes = np.array(sizes)
    places = sharding.even_bins(sizes, bins)
    assert places.min() >= 0 and places.max() < bins
    loads = np.bincount(places, sizes, minlength=bins)
    fair = sizes.sum() / bins
    assert loads.max() <= max(sizes.max() + fair, sizes.max())


def test_one_huge_group_leaves_the_others_even():
    sizes = np.array([10**6, *([7] * 3000), *([11] * 2000)])
    loads = np.bincount(sharding.even_bins(sizes, 6), sizes)
    assert sorted(loads)[-1] == 10**6 and max(sorted(loads)[:-1]) - min(loads) <= 11


def test_size_above_capacity_is_refused():
    with pytest.raises(ValueError):
        sharding.fewest_bins(np.array([3, 9]), 8)


def check(docs, rows, shards):
    texts = sorted(((d.doc_id, d.text) for d in docs.collect()), key=str)
    want = sorted(
        ((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts), key=str
    )
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[bytes(r.group)].add(r.shard)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    return loads


def test_shards_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads = check(docs, sharding.sharded(docs).collect(), 24)
    assert len(loads) == 24 and max(loads.values()) <= 1.002 * min(loads.values())


@settings(max_examples=200, deadline=None)
@given(sizes_list, st.integers(1, 8), st.integers(50, 200))
def test_runs_are_best_fit_one_by_one(sizes, bins, capacity):
    falling = np.array(sorted(sizes, reverse=True))
    places = sharding.best_fit(falling, capacity, bins)
    kinds, counts = np.unique(-falling, return_counts=True)
    runs = sharding.fit_runs((-kinds).tolist(), counts.tolist(), capacity, bins)
    assert (runs is None) == (places is None)
    if runs is not None:
        found = sorted((s, b) for s, b, n in runs for _ in range(n))
        assert found == sorted(zip(falling.tolist(), places.tolist(), strict=True))
    values, n = np.unique(falling, return_counts=True)
    loads, want = np.zeros(bins), np.bincount(sharding.even_bins(falling, bins), falling, minlength=bins)
    for s, b, k in sharding.even_runs(values, n, bins):
        loads[b] += s * k
    assert loads.tolist() == want.tolist()


def test_many_small_groups():
    """Every group goes through best fit: as item by item, and loads within 0.2 percent."""
    sizes = np.random.default_rng(2).zipf(1.3, 100_000).clip(1, 3000) + 8
    places = sharding.even_bins(sizes, 24)
    values, counts = np.unique(sizes, return_counts=True)
    runs = sharding.even_runs(values, counts, 24)
    loads = np.zeros(24)
    for s, b, k in runs:
        loads[b] += s * k
    assert loads.tolist() == np.bincount(places, sizes, minlength=24).tolist()
    assert loads.max() <= 1.002 * loads.min()
    assert sum(k for *_, k in runs) == len(sizes)


def test_blocks_of_slots(documents, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 5)
    check(documents, sharding.sharded(documents, shards=5).collect(), 5)


def test_odd_and_empty(odd_docs, documents):
    check(odd_docs, sharding.sharded(odd_docs, shards=3).collect(), 3)
    assert sharding.sharded(documents.limit(0)).count() == 0
