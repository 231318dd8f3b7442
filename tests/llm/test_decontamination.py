"""Retrieval and confirmation against plain loops over all passages and items."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from salesloom.llm import decontamination as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def split(items):
    """Entries: item, words, and how many of them it may lack."""
    out = []
    for item_id, text in items:
        parts = [words(t) for t in text.partition("\n")[::2]]
        if sum(map(len, parts)) < dc.LEAST_WORDS:
            continue
        for own in [max(parts, key=len)]:
            n, run = -(-len(own) // dc.ENTRY_WORDS), min(5, len(own))
            runs = {tuple(own[i : i + run]) for i in range(len(own) - run + 1)}
            missing = len(runs) - math.ceil(dc.OVERLAP * len(runs) - 1e-9)
            size, more = divmod(len(own), n)
            at = 0
            for k in range(n):
                end = at + size + (k < more)
                out.append((item_id, text, missing // n, own[at:end]))
                at = end
    return out


def retrieved(items, text, share=1.0):
    """Best share of each item (by place) over all passages, scored without any bound."""
    entries = split(items)
    df = Counter(t for *_, own in entries for t in set(own))
    mean = sum(len(own) for *_, own in entries) / max(len(entries), 1)
    best = {}
    own_text, half = words(text), dc.PASSAGE_WORDS // 2
    for start in range(0, max(len(own_text), 1), half):
        query = set(own_text[start : start + dc.PASSAGE_WORDS])
        for item_id, item_text, spare, own in entries:
            weights = {}
            for t, n in Counter(own).items():
                idf = math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5))
                norm = dc.K1 * (1 - dc.B + dc.B * len(own) / mean)
                weights[t] = idf * n * (dc.K1 + 1) / (n + norm)
            needed = sum(sorted(weights.values(), reverse=True)[spare:])
            score = sum(w for t, w in weights.items() if t in query) / needed
            if score >= share - 1e-9:
                best[(item_id, item_text)] = max(best.get((item_id, item_text), 0), score)
    return best


def overlap(part, text):
    own = words(part)
    if not own:
        return None
    n = min(5, len(own))
    runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    have = words(text)
    seen = {tuple(have[i : i + n]) for i in range(len(have) - n + 1)}
    if n == 5 and len(have) < 5 and have:
        seen = set()
    return len(runs & seen) / len(runs)


def brute(items, docs):
    out = []
    for doc_id, text in docs:
        for (item_id, item_text), share in retrieved(items, text).items():
            question, _, answer = item_text.partition("\n")
            q, a = overlap(question, text), overlap(answer, text)
            if (q is None or q >= dc.OVERLAP) and (a is None or a >= dc.OVERLAP):
                out.append((doc_id, item_id, round(share, 9), q, a))
    return sorted(out, key=str)


def answer(docs, items):
    rows = dc.matches(docs, items).collect()
    return sorted(
        ((r.doc_id, r.item_id, round(r["share"], 9), r.question_overlap, r.answer_overlap) for r in rows),
        key=str,
    )


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_given_documents(spark, documents):
    docs = documents.where("length(text) < 6000")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([tuple(r) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert answer(docs, items) == want and want


def test_bounds_lose_nothing(spark, docs_of):
    """Common words only, entries that share most words, long items, low thresholds."""
    base = [f"w{i % 17}" for i in range(90)]
    items = [" ".join(base[k : k + 40]) for k in range(0, 50, 7)] + [" ".join(f"u{i}" for i in range(150))]
    texts = [" ".join(base), " ".join(base[::-1]), "x " * 50 + items[0], items[-1] + " tail", "w1 w2 u3 u4 u5"]
    texts += [" ".join(f"u{i}" for i in range(20, 140))]
    docs, table = docs_of(texts), items_of(spark, items)
    assert answer(docs, table) == brute(list(enumerate(items)), list(enumerate(texts)))
    index = next(dc._shards(table, "item_id", "text"))
    import pyarrow as pa

    from salesloom.llm import arrays

    flat, starts = arrays.words(pa.array(texts), lower=True)
    for share in (0.05, 0.3, 0.6):
        got = dc.retrieve(index, arrays.word_hashes(flat), starts, share)
        got = {(t, index.item_ids[i]): round(s, 9) for t, i, s in got}
        want = {
            (n, i): round(s, 9)
            for n, text in enumerate(texts)
            for (i, _), s in retrieved(list(enumerate(items)), text, share).items()
        }
        assert got == want


def test_question_and_answer(spark, docs_of):
    item = "who wrote the famous long book about whales\nherman melville did so"
    texts = [
        f"intro {item.replace(chr(10), ' ')} outro",
        "who wrote the famous long book about whales nobody knows",
        "herman melville did so",
        "WHO wrote the famous long book about whales ... and later: herman melville did so.",
    ]
    got = {r[0] for r in answer(docs_of(texts), items_of(spark, [item, None, "", "two words"]))}
    assert got == {0}


def test_parts_far_from_each_other(spark, docs_of):
    """Eight of nine words of question and answer each, 200 words apart, and rare last words."""
    question = [f"q{i}" for i in range(9)]
    answer_words = [f"a{i}" for i in range(9)]
    common = [" ".join(question[:8] + answer_words[:8])] * 30
    items = [f"{' '.join(question)}\n{' '.join(answer_words)}", *common]
    gap = " ".join(f"x{i}" for i in range(200))
    texts = [
        f"{' '.join(question[:8])} {gap} {' '.join(answer_words[:8])}",
        f"{gap} {' '.join(answer_words[:8])} {gap} {' '.join(question[:8])}",
        f"{' '.join(question[:7])} {gap} {' '.join(answer_words[:8])}",
    ]
    for bare in (False, True):
        found = dc.matches(docs_of(texts), items_of(spark, items), bare=bare).where("item_id = 0").collect()
        assert {(r.doc_id, r.question_overlap, r.answer_overlap) for r in found} == {(0, 0.8, 0.8), (1, 0.8, 0.8)}


def test_short_items_and_signs_in_the_query(spark, docs_of):
    items = ["short\nphrase", "herman melville, did so"]
    texts = ["a (short) phrase!", "phrase short", "Herman Melville did so.%%%", "herman did so melville"]
    got = dc.matches(docs_of(texts), items_of(spark, items), bare=True).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (2, 1)}


def test_shards_and_clean(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = answer(documents, items)
    monkeypatch.setattr(dc, "SHARD_WORDS", 300)
    assert answer(documents, items) == whole
    left = dc.clean(documents, items)
    hit = {r[0] for r in whole}
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in documents.collect()} - hit


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_odd_and_empty(spark, odd_docs, documents, empty):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    if empty == "docs":
        assert dc.matches(documents.limit(0), items).count() == 0
        odd = items_of(spark, [r.text for r in odd_docs.collect()])
        got = {(r.doc_id, r.item_id) for r in dc.matches(odd_docs, odd).collect()}
        assert {d for d, _ in got} == {4, 5, 7, 8, None}
    else:
        assert dc.matches(odd_docs, items.limit(0)).count() == 0
        assert dc.clean(odd_docs.withColumn("item", F.lit(1)), items.limit(0)).count() == odd_docs.count()


def test_bare_words(spark, docs_of):
    """Signs on words, a short answer with a lost word, and items of few words."""
    text = (
        "Die. Ber enachver als lichgete erachein ßü schau. Keitein schge tzkeit bech erauung.\n"
        "Erpfsch in ieungber keitau chbeheitä."
    )
    items = [text, "who wrote the famous long book about whales\nherman melville did so back then", "short\nphrase", None, " . "]
    question = items[1].split("\n")[0]
    texts = [
        f"=== junk {text.replace(chr(10), ' ')}%%% junk",
        f"{question} ... and later: herman melville did it back then.",
        f"herman melville did it back then. {question}",
        f"{question} {'x ' * 40} herman melville did it back then.",
        f"{question} and herman wrote back",
        "a short, phrase.",
        "a phrase short",
        ". ... !",
        None,
    ]
    got = dc.matches(docs_of(texts), items_of(spark, items), bare=True, in_order=True).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (5, 2)}
    left = dc.clean(docs_of(texts), items_of(spark, items), bare=True, in_order=True)
    assert {r.doc_id for r in left.collect()} == set(range(9)) - {0, 1, 5}


def test_document_262(spark):
    """Item 11 word for word, with signs on its last word: the stage drops the document."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id = 262")
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    assert [r.item_id for r in dc.matches(docs, items, bare=True).collect()] == [11]
    assert docs.count() == 1 and corpus_pipeline.drop_test_items(spark, docs, "/root/testdata/sf0.1").count() == 0
