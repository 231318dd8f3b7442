"""Stages of the pipeline against plain loops at the thresholds that they state."""

import random
import zlib

import corpus_pipeline

from .test_near_dedup import shingle_set


def test_near_copies_between_80_and_85_percent(spark, docs_of):
    """Pairs of 0.80 to 0.85 go, pairs below 0.80 stay, as by comparing all pairs."""
    rng = random.Random(3)
    texts = []
    for changed in (1, 2, 3, 4, 5, 6) * 4:
        words = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        texts.append(" ".join(words))
        for k in range(changed):
            words[10 + 18 * k] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    shares = {
        (i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
    }
    linked = {pair for pair, share in shares.items() if share >= 0.8}
    assert any(0.8 <= shares[p] < 0.85 for p in linked)
    assert any(0.6 < s < 0.8 for s in shares.values())
    want = set(range(len(texts))) - {i for i, _ in linked}
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(texts), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_languages_are_learnt_from_all_documents(spark):
    """A language whose documents all have ids that ``op4`` holds out is known to the pipeline."""
    rng = random.Random(5)

    def text(letters):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(80))

    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2][:40]
    rows = [(k, text("αβγδεζηθικλμ"), "el") if k in held else (k, text("abcdefghijkl"), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert kept == set(range(400))
