"""Words and variants against plain counting and blanked words."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesloom.llm import spelling

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i] + "\0" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for words in holes.values():
        for w in words if len(words) > 1 else ():
            near[w] |= words - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near[w]), None if f is None else n[f]))
    return sorted(out, key=str)


NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def collected(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert collected(spelling.spelling_variants(docs)) == want
    assert sum(r[1] is not None for r in want) > 100


def test_chains_ties_and_common_halves(spark):
    """Forms of forms, equal counts, many words with the same beginning or ending."""
    rng = random.Random(9)
    n = {"abcdefg": 5, "abcdefh": 25, "abcdeeh": 125, "abcdeehh": 700, "zbcdefg": 25, "abcdef": 25, "éèêëàâ": 9, "éèêëàä": 45}
    while len(n) < 3000:
        word = "".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))
        n.setdefault(rng.choice(["common" + word, word + "common"]), rng.randint(5, 400))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert collected(spelling.variants(words)) == plain_variants(n)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=9), min_size=2, max_size=40, unique=True))
def test_every_pair_at_one_edit_meets(spark, words):
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long").coalesce(1)
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()}
    want = {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}
    assert got == want


def test_odd_empty_and_clashing(spark, odd_docs, documents):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert collected(spelling.spelling_variants(odd_docs)) == plain_variants(plain_words(rows))
    names = ("run", "h", "id", "word", "n", "key", "form")
    texts = [(None, "Straße ÀÉÎÕÜß " * 9), (1, "x" * 50_000 + " abcdef" * 6), (1, None), (2, "abcde2fghij÷×÷×÷×")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in names})
    assert collected(spelling.spelling_variants(docs)) == plain_variants(plain_words(texts))
    assert spelling.spelling_variants(documents.limit(0)).count() == 0
