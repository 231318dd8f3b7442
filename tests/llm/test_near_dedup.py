"""Groups of near duplicates against a comparison of every pair."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import arrays, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = WORD.findall(low)
    if not found:
        return set()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[top(i)] = top(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[top(i)] = min(best.get(top(i), key), key)
    return sorted(
        (
            (k, len(s), best.get(top(i)) if s else k)
            for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))
        ),
        key=str,
    )


def answer(docs):
    return sorted(
        ((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()),
        key=str,
    )


def test_given_documents(documents, document_rows):
    assert answer(documents) == brute([r[:2] for r in document_rows])


def test_odd_documents(odd_docs):
    assert answer(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_chains_and_a_large_group(docs_of):
    """A chain of small edits reaches far; neighbours of a base link through it only."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts, current = [], list(base)
    for step in range(25):
        current = list(current)
        current[step * 4] = f"n{step}"
        texts.append(" ".join(current))
    for i in range(60):
        other = list(base)
        other[2 * i] = f"m{i}"
        texts.append(" ".join(other).upper() if i % 2 else " ".join(other))
    for i in range(40):
        texts.append(" ".join(base[:60] + [f"z{i}_{j}" for j in range(60)]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = docs_of([texts[i] for i in order])
    assert answer(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each(odd_docs, docs_of):
    left = near_dedup.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    want = [(r.doc_id, r.text) for r in odd_docs.collect()]
    by_row = near_dedup.near_duplicates(odd_docs).where("kept").select("doc_id").distinct().count()
    real = [r for r in left.collect() if shingle_set(r.text)]
    assert len({r.doc_id for r in left.collect()}) == by_row
    assert len(real) == len({(r.doc_id, r.text) for r in real})
    blank = [k for k, t in want if not shingle_set(t)]
    assert sorted(r.doc_id for r in left.collect() if not shingle_set(r.text)) == sorted(blank)
    twins = docs_of(["a b c d e f g", "a b c d e f g", "q w e r t y"], ids=[7, 7, 7])
    assert sorted(r.text for r in near_dedup.one_of_each(twins).collect()) == [
        "a b c d e f g", "q w e r t y",
    ]


def test_empty_table_and_clashing_names(documents):
    none = documents.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(none).columns == documents.columns
    named = documents.withColumns(
        {c: F.lit(1) for c in ("node", "label", "bucket", "n_shingles", "set_key", "text_hash")}
    )
    assert near_dedup.one_of_each(named).count() == near_dedup.one_of_each(documents).count()


def test_pairs_of_leads_meet_once_without_an_aggregate(spark):
    bands, short = list(range(16)), [0] * (near_dedup.SKETCH // 64)
    rows = [(b, b, n, n, n < 2, 10, bands, short) for b in bands for n in range(3)]
    kind = "band int, bucket long, node long, label long, lead boolean, n_shingles long, "
    opened = spark.createDataFrame(rows, kind + "bands array<long>, sketch array<long>")
    found = near_dedup._pairs(opened, 85, 16)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (1, 2)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = want.get(node, node)
                todo += near[x]
    got = near_dedup.components(spark.createDataFrame(edges, "x long, y long"))
    loops = {n for n, others in near.items() if others == {n}}
    assert {r.node: r.label for r in got.collect()} == {k: v for k, v in want.items() if k not in loops}


def test_signature_follows_its_definition():
    scatter, _ = near_dedup.permutations(8)
    rng = np.random.default_rng(near_dedup.SEED)
    rng.permutation(near_dedup.RING)
    ring = rng.permutation(near_dedup.RING)
    values = arrays.mix(np.arange(1, 50, dtype=np.uint64))
    low = near_dedup.signature(values, 8)
    for k in range(8):
        places = [(int(scatter[int(v) >> 44]) + k) % near_dedup.RING for v in values]
        assert low[k] == min(int(ring[p]) for p in places)


@pytest.mark.parametrize("share", [0.5, 0.85])
def test_signature_estimates_similarity(share):
    n = 2000
    keep = int(2 * n * share / (1 + share))
    agree = []
    for trial in range(20):
        a = arrays.mix(np.arange(n, dtype=np.uint64) + np.uint64(trial * 10_000_000))
        b = arrays.mix(np.arange(n - keep, 2 * n - keep, dtype=np.uint64) + np.uint64(trial * 10_000_000))
        agree.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
    assert abs(np.mean(agree) - share) < 0.03


def test_sketch_keeps_pairs_at_the_threshold():
    n, share = 400, 0.85
    keep = int(2 * n * share / (1 + share)) + 1
    limit, near, far = near_dedup.most_different(85), [], []
    for trial in range(60):
        shift = np.uint64(trial * 10_000_000)
        a = arrays.mix(np.arange(n, dtype=np.uint64) + shift)
        b = arrays.mix(np.arange(n - keep, 2 * n - keep, dtype=np.uint64) + shift)
        c = arrays.mix(np.arange(n // 3, n + n // 3, dtype=np.uint64) + shift)
        bits = [np.unpackbits(near_dedup.sketch(x).view(np.uint8)) for x in (a, b, c)]
        near.append(int((bits[0] != bits[1]).sum()))
        far.append(int((bits[0] != bits[2]).sum()))
    assert max(near) <= limit < min(far)
