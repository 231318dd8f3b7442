"""Language models against a plain dictionary version, held-out accuracy, odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from salesloom.llm import arrays, language


def grams(word, order):
    """(context, character) of each prediction, longest context first."""
    clean = [c for c in word.lower() if c.isalpha()]
    if not clean:
        return []
    chars = [" ", *clean, " "]
    return [(tuple(chars[max(0, i - order + 1) : i]), chars[i]) for i in range(1, len(chars))]


class Plain:
    """Interpolated Kneser-Ney over dictionaries for one language."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        raw = defaultdict(Counter)
        for text in texts:
            for word in text.split():
                for context, char in grams(word, order):
                    for k in range(len(context) + 1):
                        raw[k][(*context[len(context) - k :], char)] += 1
        self.counts = {}
        for k in range(order):
            kinds = Counter(g[1:] for g in raw[k + 1]) if k + 1 < order else {}
            self.counts[k] = {g: kinds.get(g, 0) or n for g, n in raw[k].items()}
        self.discount, self.total, self.kinds = {}, Counter(), Counter()
        for k, table in self.counts.items():
            ones = sum(n == 1 for n in table.values())
            twos = sum(n == 2 for n in table.values())
            d = ones / max(ones + 2 * twos, 1) if ones else 0.5
            self.discount[k] = min(max(d, 0.1), 0.9)
            for g, n in table.items():
                self.total[(k, g[:-1])] += n
                self.kinds[(k, g[:-1])] += 1

    def p(self, context, char):
        k = len(context)
        lower = 1 / (self.alphabet + 1) if k == 0 else self.p(context[1:], char)
        total = self.total[(k, context)]
        if not total:
            return lower
        d = self.discount[k]
        own = max(self.counts[k].get((*context, char), 0) - d, 0) / total
        return own + d * self.kinds[(k, context)] / total * lower


TEXTS = {
    "aa": ["the cat sat on the mat", "that hat is the cat's", "a mat, a HAT; the end the the"],
    "bb": ["der hund und die maus", "das haus und der hund", "über der straße und dem haus"],
}


def counted(spark, order):
    rows = [(t, lang) for lang, ts in TEXTS.items() for t in ts]
    df = spark.createDataFrame(rows, "text string, lang string")
    return df, df.mapInArrow(language._count(order), language._COUNTED)


def test_model_equals_plain_version(spark):
    order = 4
    df, rows = counted(spark, order)
    summed = rows.groupBy("lang", "order", "key").agg(
        F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")
    )
    model = language.estimate(summed.toArrow(), order)
    alphabet = len({c for ts in TEXTS.values() for t in ts for c in t.lower() if c.isalpha()} | {" "})
    probes = ["the", "hund", "xyzzy", "maus", "that!", "Straße", "q", "thund"]
    sums, chars, _ = model.word_scores(probes)
    for j, lang in enumerate(model.langs):
        plain = Plain(TEXTS[lang], order, alphabet)
        for i, word in enumerate(probes):
            want = sum(math.log(plain.p(c, x)) for c, x in grams(word, order))
            assert math.isclose(sums[i, j], want, rel_tol=1e-5), (lang, word)
            assert chars[i] == len(grams(word, order))


def test_probabilities_sum_to_one(spark):
    _, rows = counted(spark, 3)
    rows = rows.groupBy("lang", "order", "key").agg(
        F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")
    )
    model = language.estimate(rows.toArrow(), 3)
    letters = sorted({c for ts in TEXTS.values() for t in ts for c in t.lower() if c.isalpha()})
    sums, _, _ = model.word_scores(["a" + c for c in letters] + ["a"])
    first, _, _ = model.word_scores(["a"])
    assert np.isfinite(sums).all() and (sums < 0).all() and (first < 0).all()


def test_each_ngram_has_its_own_row(spark):
    """As many rows as distinct n-grams, and as many n-grams on a context as it has."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 8)) for _ in range(5000)]
    df = spark.createDataFrame([(" ".join(words), "zh")], "text string, lang string")
    counted = df.mapInArrow(language._count(5), language._COUNTED).toPandas()
    want = defaultdict(set)
    for word in words:
        for context, char in grams(word, 5):
            for k in range(len(context) + 1):
                want[k + 1].add((*context[len(context) - k :], char))
    for k in range(1, 6):
        own = counted[counted["order"] == k]
        assert own.key.nunique() == len(want[k])
        assert own.context.nunique() == len({g[:-1] for g in want[k]})


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out("doc_id")))
    truth = docs.select("doc_id", "lang", "text").where(language.held_out("doc_id"))
    got = language.identify(truth, model).join(truth, "doc_id").collect()
    known = [r for r in got if r.lang_pred != language.UNKNOWN]
    assert len(known) > 200 and sum(r.lang_pred == r.lang for r in known) / len(known) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in known) / len(known) < 0.01
    alien = spark.createDataFrame([(1, "щ ж " * 200), (2, "zxqj kwvx qqzx jjkq " * 50)], "doc_id long, text string")
    assert all(r.rejected for r in language.identify(alien, model).collect())


def test_bounds_with_wrong_and_mixed_labels():
    """Mislabelled, mixed and foreign texts in the sample do not loosen a bound."""
    rng = np.random.default_rng(7)
    vocabulary = {
        lang: ["".join(rng.choice(list(letters), 6)) for _ in range(300)]
        for lang, letters in (("aa", "abcdefgh"), ("bb", "nopqrstu"))
    }

    def texts(lang, n):
        return [" ".join(rng.choice(vocabulary[lang], 80)) for _ in range(n)]

    learned = [(t, lang) for lang in vocabulary for t in texts(lang, 60)]
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": lang} for t, lang in learned])
    counted = pa.Table.from_batches(language._count(5)(iter([batch])))

    def calibrated(rows):
        sample = pa.Table.from_pylist([{"text": t, "lang": lang} for t, lang in rows])
        return language.calibrate(language.estimate(counted), sample)

    clean = [(t, lang) for lang in vocabulary for t in texts(lang, 60)]
    mixed = [
        f"{' '.join(a.split()[:48])} {' '.join(b.split()[:32])}"
        for a, b in zip(texts("aa", 3), texts("bb", 3), strict=True)
    ]
    alien = ["zxyv kwvx vyzz jjkw " * 30]
    planted = [(t, "aa") for t in [*texts("bb", 3), *mixed, *alien]]
    model, other = calibrated(clean), calibrated(clean + planted)
    assert np.allclose(model.spread, other.spread, rtol=0.2)
    assert all(other.judged(pa.array(alien))[2])
    assert not any(other.judged(pa.array([t for t, _ in clean]))[2])


def test_all_texts_are_counted(spark):
    """A language with one text, or two, is learned, also if the hash sets the text apart."""
    rng = np.random.default_rng(11)
    names = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts = spark.createDataFrame([(f"{a} {b}",) for a, b in zip(names, names[1:], strict=False)], "text string")
    low = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(0.1 * (1 << 30))
    falls = [r.text for r in texts.where(low).collect()]
    rows = [(r.text, "aa") for r in texts.collect()] + [(falls[0], "bb")] * 3 + [(t, "cc") for t in falls[1:3]]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(df)
    assert model.langs == ["aa", "bb", "cc"]
    want = df.mapInArrow(language._count(5), language._COUNTED).toPandas()
    for k in range(1, 6):
        assert set(model.keys[k - 1]) == set(want[want["order"] == k].key)
    assert np.isfinite(model.spread[[0, 2]]).all()


def test_odd_documents(odd_docs, documents):
    model = language.train(documents)
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    blank = {k for k, t in texts if not any(c.isalpha() for c in t or "")}
    for r in rows:
        assert (r.lang_pred == "und" and r.score == 0 and r.rejected) or r.doc_id not in blank or r.doc_id == 3
    kept = language.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())


def test_nothing_to_learn_and_empty(documents, odd_docs):
    model = language.train(documents.where("lang = 'none'"))
    assert {r.lang_pred for r in language.identify(odd_docs, model).collect()} == {"und"}
    assert language.accepted(odd_docs, model).count() == 0
    assert language.identify(documents.limit(0), language.train(documents)).count() == 0


def test_slices_do_not_change_a_score(documents):
    model = language.train(documents)
    texts = pa.array([r.text for r in documents.limit(20).collect()])
    whole = model.judged(texts)
    for i in range(len(texts)):
        one = model.judged(texts.slice(i, 1))
        assert one[0][0] == whole[0][i] and abs(one[1][0] - whole[1][i]) < 1e-9


def test_training_leaves_nothing_held_in_the_driver(docs_of):
    held = arrays.memory()
    held["texts"] = ["of an earlier stage"]
    docs = docs_of(["ein Haus am See", "das alte Haus"], lang="de")
    model = language.train(docs)
    assert model.langs == ["de"] and not held
