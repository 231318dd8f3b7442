"""Base counts against plain loops, tree growth, monotonic scores, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
        seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
    }


TEXT = st.text(alphabet="ab \n\t\x0b\x1c é中#|", max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=5))
def test_base_counts(texts):
    base, x = quality.statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {c: int(base[c][i]) for c in quality.BASE} == plain(text)
    assert np.isfinite(x).all() and x.shape == (len(texts), len(quality.DIRECTION))


def test_statistics_do_not_depend_on_neighbours(document_rows):
    texts = pa.array([r[1] for r in document_rows[:40]])
    _, x = quality.statistics(texts)
    for i in range(0, 40, 7):
        assert np.allclose(quality.statistics(texts.slice(i, 1))[1][0], x[i])


def walk(trees, root, row):
    node = root
    while trees.left[node] != node:
        low = row[trees.feature[node]] <= trees.bound[node]
        node = trees.left[node] if low else trees.right[node]
    return trees.value[node]


def test_flat_trees_score_like_single_walks_and_keep_to_directions():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    good = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 3000)) > 0.6
    trees = quality.fit(x, good, np.array([1, 0, -1]))
    p = trees.probability(x[:50])
    for i in range(50):
        total = trees.start + sum(walk(trees, r, x[i]) for r in trees.roots)
        assert abs(p[i] - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((trees.probability(x) > 0.5) == good).mean() > 0.8
    for feature, sign in ((0, 1), (2, -1)):
        for row in x[:40]:
            line = np.repeat(row[None], 101, axis=0)
            line[:, feature] = np.linspace(0, 1, 101)
            assert (sign * np.diff(trees.probability(line)) >= -1e-12).all()


def test_one_class_gives_no_trees():
    assert quality.fit(np.ones((5, 2)), np.ones(5, dtype=bool), np.zeros(2)) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0")
    rows = quality.judge(docs, trees).join(held, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(not r.kept for r in bad) / len(bad) > 0.9


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_and_empty(spark, odd_docs, documents, labelled):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trees = quality.train(documents, labels if labelled else labels.limit(0))
    rows = quality.judge(odd_docs, trees).collect()
    want = sorted((str(r.doc_id), *plain(r.text).values()) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), *(r[c] for c in quality.BASE)) for r in rows) == want
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)
        assert labelled or r.kept != failed
    assert quality.judge(documents.limit(0), trees).count() == 0
