"""Trees against a plain level-by-level version, proofs, and changed rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from salesloom.llm import merkle

from .conftest import DOC


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """The top, and for each leaf the steps (sibling to the left, sibling or None)."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            other = places[i] ^ 1
            path.append((places[i] % 2 == 1, nodes[other] if other < len(nodes) else None))
            places[i] //= 2
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain(rows):
    """Rows of ``document_manifest`` for (doc_id, text, lang, source, n_chars)."""

    def leaf(r, more=0):
        k, text, lang, source, n = r
        return digest(*map(written, (k, source, lang, None if n is None else n + more, text)))

    def order(r):
        return (r[0] is not None, r[0] or 0, leaf(r))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [(sorted(groups[g], key=order), *plain_tree([leaf(r) for r in sorted(groups[g], key=order)])) for g in names]
    if not trees:
        return []
    root, crowns = plain_tree([top for _, top, _ in trees])
    out = []
    for (own, top, paths), crown in zip(trees, crowns, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            found = leaf(r, 1) if changed and r[4] is not None else leaf(r)
            for left, other in path + crown:
                found = digest(other or "", found) if left else digest(found, other or "")
            proof = digest(*[o for _, o in path + crown if o])
            out.append((r[0], leaf(r), top, root, proof, found, found == root))
    return sorted(out, key=str)


def answer(docs):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.document_manifest(docs).select(names).collect()), key=str)


@pytest.mark.parametrize("digits", [1, 2, 8])
def test_same_as_level_by_level(spark, monkeypatch, digits):
    """Groups of every size around the block's, a hot group, nulls, ties and repeated rows."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(digits)
    rows = [(i, f"text é {i}", rng.choice(["en", "en", "en", "de", "é", "", None]), "s", i) for i in range(90)]
    rows += [(1000 + i, "x", f"lang{n}", None, None) for n in range(1, 10) for i in range(n)]
    rows += [(5, "other", "en", "s", 1), (5, "other", "en", "s", 1), (None, None, "en", None, 3), (7, "", "en", "", 2**63 - 1)]
    docs = spark.createDataFrame(rows, DOC)
    assert answer(docs) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    assert answer(spark.createDataFrame(rows, DOC)) == plain(rows)


def test_given_documents(documents):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.collect()]
    got = answer(documents)
    assert got == plain(rows)
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 7 != 0) for r in got)


def test_odd_texts_and_clashing_names(spark, odd_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    names = ("g", "g_null", "place", "total", "digest", "payload", "block", "leaf", "node", "path", "_range", "k")
    named = odd_docs.withColumns({c: F.lit(1) for c in names})
    assert answer(named) == plain(rows)


def test_own_columns_and_paths(spark):
    """The general form: other columns, and paths that lead from each leaf to the root."""
    rows = spark.createDataFrame([(i % 3, f"v{i}", i) for i in range(40)], "part int, value string, id int")
    found = merkle.manifest(rows, "id", "part", merkle.leaf_digest([F.col("id"), F.col("value")]), F.struct("id"))
    found = found.withColumn("up", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(found) == 40 and all(r.up == r.root for r in found) and len({r.subroot for r in found}) == 3
