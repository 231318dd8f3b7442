"""Language identification by character models with interpolated Kneser-Ney smoothing.

One model for each language gives the probability of every letter of a word, and of
the word's end, from up to four characters before it. Counts cover all training
documents. N-grams live in hash arrays sorted by key, one for each order, with a
column for each language; a text takes the language with the lowest cross-entropy
per character. Words are scored once for each distinct word of a slice.

Size of a model: an n-gram's key is a hash of 64 bits, so an order has one row for each
distinct n-gram. The tables grow with these, and go to the driver and to each task whole.

The score is the probability of the chosen language, softmax(-sharpness * entropy),
and ``rejected`` marks texts that fit no language: the entropy lies above its median
by more than ``MARGIN`` times the median distance from it in calibration, where texts
that the models give to another language than their label do not count (unless all are). A language with
fewer than ``FEW_TEXTS`` such texts takes the median distance of all, if that is larger.
The distance allowed is one number for texts of ``LONG`` characters or more; for shorter
ones it grows with the square root of what they lack. Sharpness and distances come from
about ``SAMPLE_ROWS`` distinct labelled texts, a tenth at most, and a model without them;
the model that is used counts them as well.

Defined results: a null text and one without letters are ``und`` with score 0, and
rejected; so is every text when there is nothing to learn from. Ties go to the first
language in alphabetical order. Repeated rows and ids are scored row by row. An empty
table gives an empty result. Other columns do not matter and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm import arrays
from salesloom.workspace import stage

UNKNOWN = "und"
ORDER = 5
SAMPLE_ROWS = 4000
MARGIN = 40.0
FEW_TEXTS = 20
LONG = 400
LEAST_SPREAD = 0.5
SLICE_BYTES = 3 << 19
# Rows of counts that a task holds before it adds them up, and before it passes them on.
HELD_ROWS = 250_000
SPACE = 32

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(
            np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        )
    return _letters[0]


@dataclass
class Events:
    """Predicted characters of a list of words, with n-gram keys of every order."""

    word: np.ndarray
    depth: np.ndarray
    keys: list[np.ndarray]
    context: list[np.ndarray]
    suffix: list[np.ndarray]
    n_letters: np.ndarray


def events(words: list[str], order: int = ORDER) -> Events:
    """A word is a space, its letters in lower case, and a space; other characters go."""
    text = " " + " ".join(words).lower() + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = letters()[codes] | (codes == SPACE)
    codes = codes[keep].astype(np.uint64)
    space = codes == SPACE
    owner = np.cumsum(space) - 1
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(space, at, 0))
    before = np.concatenate([[0], last[:-1]])
    event = np.flatnonzero(~space | np.concatenate([[False], ~space[:-1]]))
    n_letters = np.bincount(owner[~space], minlength=len(words))[: len(words)]
    grams = [arrays.mix(codes + np.uint64(1))]
    for _ in range(1, order):
        earlier = np.concatenate([np.zeros(1, np.uint64), grams[-1][:-1]])
        grams.append(arrays.mix(earlier * np.uint64(0x9E3779B97F4A7C15) + codes))
    grams = [g.view(np.int64) for g in grams]
    keys, context, suffix = [], [], []
    empty = np.zeros(len(event), dtype=np.int64)
    for k in range(order):
        keys.append(grams[k][event])
        context.append(grams[k - 1][event - 1] if k else empty)
        suffix.append(grams[k - 1][event] if k else empty)
    return Events(
        (owner[event] - space[event]).astype(np.int64),
        np.minimum(event - before[event] + 1, order),
        keys,
        context,
        suffix,
        n_letters,
    )


def _distinct(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and each text's first place."""
    flat, starts = arrays.words(texts)
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), starts


def _count(order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        names: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            for part in arrays.sliced(batch, "text", SLICE_BYTES):
                found, index, starts = _distinct(part.column("text"))
                if not found:
                    continue
                langs = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()])
                each = np.repeat(langs, np.diff(starts))
                own = events(found, order)
                for lang in np.unique(each):
                    counts = np.bincount(index[each == lang], minlength=len(found))[own.word]
                    for k in range(order):
                        use = (own.depth > k) & (counts > 0)
                        rows = _summed(
                            own.keys[k][use], own.context[k][use], own.suffix[k][use], counts[use]
                        )
                        held.append((k + 1, int(lang), *rows))
                        size += len(rows[0])
                if size > HELD_ROWS:
                    held = _folded(held)
                    size = sum(len(h[2]) for h in held)
                    if size > HELD_ROWS // 2:
                        yield from _rows(held, names)
                        held, size = [], 0
        yield from _rows(_folded(held), names)

    return work


def _summed(keys, context, suffix, counts):
    low, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return low, context[first], suffix[first], np.bincount(inverse, counts).astype(np.int64)


def _folded(held: list) -> list:
    groups: dict[tuple[int, int], list] = {}
    for k, lang, *rows in held:
        groups.setdefault((k, lang), []).append(rows)
    return [
        (*group, *_summed(*(np.concatenate(c) for c in zip(*rows, strict=True))))
        for group, rows in groups.items()
    ]


_COUNTED = "lang string, order int, key long, context long, suffix long, n long"


def _rows(held: list, names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    by_number = {v: k for k, v in names.items()}
    for k, lang, keys, context, suffix, counts in held:
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([by_number[lang]] * n, pa.string()),
                pa.array(np.full(n, k, np.int32)),
                pa.array(keys),
                pa.array(context),
                pa.array(suffix),
                pa.array(counts),
            ],
            names=["lang", "order", "key", "context", "suffix", "n"],
        )


@dataclass
class Model:
    """Sorted keys of each order, log probabilities and back-off weights by language."""

    langs: list[str]
    order: int = ORDER
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of log probabilities (word x language), characters and letters of each word."""
        own = events(words, self.order)
        total = np.zeros((len(own.word), len(self.langs)))
        todo, level = np.arange(len(own.word)), own.depth.copy()
        for k in range(self.order, 0, -1):
            here = todo[level[todo] == k]
            if not len(here):
                continue
            at, hit = _find(self.keys[k - 1], own.keys[k - 1][here])
            total[here[hit]] += self.logp[k - 1][at[hit]]
            level[here[hit]] = 0
            missed = here[~hit]
            if k == 1:
                total[missed] += self.unseen
            else:
                at, hit = _find(self.keys[k - 2], own.context[k - 1][missed])
                total[missed[hit]] += self.weight[k - 2][at[hit]]
            level[missed] = k - 1
        sums = np.stack(
            [np.bincount(own.word, total[:, j], minlength=len(words)) for j in range(len(self.langs))],
            axis=1,
        )
        return sums, np.bincount(own.word, minlength=len(words)), own.n_letters

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character (text x language), characters and letters of each text."""
        found, index, starts = _distinct(texts)
        shape = (len(texts), len(self.langs))
        if not found:
            return np.zeros(shape), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        scores, chars, n_letters = self.word_scores(found)
        sums = _by_text(scores[index], starts)
        n = _by_text(chars[index], starts)
        return -sums / np.maximum(n, 1)[:, None], n, _by_text(n_letters[index], starts)

    def judged(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
        entropy, chars, n_letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        odds = np.exp(-self.sharpness * (entropy - low[:, None]))
        beyond = (low - self.mean[best]) * _weight(chars) > self.spread[best]
        known = n_letters > 0
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
        return langs, np.where(known, 1 / odds.sum(axis=1), 0.0), ~known | beyond


def _weight(chars: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(chars, 1, LONG) / LONG)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=values.dtype)
    real = np.flatnonzero(np.diff(starts))
    if len(real):
        out[real] = np.add.reduceat(values, starts[real], axis=0)
    return out


def _summed_at(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Column sums of ``values`` by place."""
    return np.stack([np.bincount(places, column, minlength=size) for column in values.T], axis=1)


def estimate(counted: pa.Table, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney estimates from summed n-gram counts."""
    coded = counted.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    model = Model(langs, order)
    if not langs:
        return model
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in names])[coded.indices.to_numpy(zero_copy_only=False)]
    column = {c: counted.column(c).to_numpy() for c in ("order", "key", "context", "suffix", "n")}
    raw, context, suffix = [], [], []
    for k in range(1, order + 1):
        use = column["order"] == k
        keys, first, inverse = np.unique(column["key"][use], return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (inverse, lang[use]), column["n"][use])
        model.keys.append(keys)
        raw.append(counts)
        below = model.keys[k - 2] if k > 1 else None
        context.append(_find(below, column["context"][use][first])[0] if k > 1 else None)
        suffix.append(_find(below, column["suffix"][use][first])[0] if k > 1 else None)
    lower = None
    for k in range(1, order + 1):
        counts = raw[k - 1]
        if k < order:  # in how many ways an n-gram continues something; a word's start does not
            kinds = _summed_at(suffix[k], raw[k] > 0, len(counts))
            counts = np.where(kinds > 0, kinds, counts)
        ones, twos = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.9)
        if k == 1:
            total, kinds = counts.sum(axis=0), (counts > 0).sum(axis=0)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            unseen = rest / (len(counts) + 1)
            p = np.maximum(counts - discount, 0) / np.maximum(total, 1) + unseen
            model.unseen = np.log(unseen)
        else:
            below = len(model.keys[k - 2])
            total = _summed_at(context[k - 1], counts, below)
            kinds = _summed_at(context[k - 1], counts > 0, below)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            held = np.maximum(counts - discount, 0) / np.maximum(total, 1)[context[k - 1]]
            p = held + rest[context[k - 1]] * lower[suffix[k - 1]]
            model.weight.append(np.log(rest).astype(np.float32))
        model.logp.append(np.log(p).astype(np.float32))
        raw[k - 1], lower = None, p
    return model


def calibrate(model: Model, sample: pa.Table) -> Model:
    """Set sharpness and rejection bounds from labelled texts."""
    n = len(model.langs)
    model.mean, model.spread = np.zeros(n), np.full(n, np.inf)
    if not n or not sample.num_rows:
        return model
    truth = np.array([model.langs.index(x) for x in sample.column("lang").to_pylist()])
    parts = [
        model.entropies(part.column("text"))[:2]
        for batch in sample.to_batches()
        for part in arrays.sliced(batch, "text", SLICE_BYTES // 4)
    ]
    entropy, chars = (np.concatenate(x) for x in zip(*parts, strict=True))
    truth, entropy, chars = truth[chars > 0], entropy[chars > 0], chars[chars > 0]
    if not len(truth):
        return model
    losses = {}
    for sharpness in 2.0 ** np.arange(0, 7.5, 0.5):
        scaled = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
        chance = scaled[np.arange(len(truth)), truth] - np.log(np.exp(scaled).sum(axis=1))
        losses[float(sharpness)] = -np.maximum(chance, -20).mean()
    model.sharpness = min(losses, key=losses.get)
    agreed = truth == entropy.argmin(axis=1)
    distance = {}
    for j in range(n):
        own = truth == j
        own = agreed & own if (agreed & own).any() else own
        if own.any():
            model.mean[j] = np.median(entropy[own, j])
            distance[j] = np.abs(entropy[own, j] - model.mean[j]) * _weight(chars[own])
    if distance:
        common = np.median(np.concatenate(list(distance.values())))
    for j, own in distance.items():
        typical = np.median(own) if len(own) >= FEW_TEXTS else max(np.median(own), common)
        model.spread[j] = max(MARGIN * typical, LEAST_SPREAD)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> Model:
    """Learn from all rows of ``docs`` that have a text and a language.

    Counting is one pass with sums in the tasks and one small shuffle. Calibration uses
    distinct texts of each language and a model that has not counted them; then they are
    counted, too. A language with two distinct texts or more sets one apart at least, one
    with a single text none, so it has no bound. The counts gathered for it leave the driver.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text is not null and lang is not null").withColumn("hash", F.xxhash64("text"))
    kinds = rows.groupBy("lang", "hash").agg(F.lit(1).alias("one")).groupBy("lang")
    kinds = stage(kinds.agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")), "kinds")
    total = kinds.agg(F.sum("n")).first()[0] or 1
    share = min(0.1, SAMPLE_ROWS / total)
    chosen = F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30))
    apart = ((F.col("hash") == F.col("low")) | chosen) & (F.col("hash") != F.col("high"))
    rows = rows.join(F.broadcast(kinds), "lang").withColumn("apart", apart)

    def counted(which: DataFrame) -> pa.Table:
        found = which.select("text", "lang").mapInArrow(_count(order), _COUNTED)
        found = found.groupBy("lang", "order", "key").agg(
            F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")
        )
        return found.toArrow()

    most = counted(rows.where("not apart"))
    model = estimate(most, order)
    sample = rows.where(F.col("apart") & F.col("lang").isin(model.langs)).select("text", "lang")
    model = calibrate(model, sample.distinct().toArrow())
    whole = estimate(pa.concat_tables([most, counted(rows.where("apart"))]), order)
    n = len(whole.langs)
    whole.sharpness, whole.mean, whole.spread = model.sharpness, np.zeros(n), np.full(n, np.inf)
    for j, name in enumerate(model.langs):
        at = whole.langs.index(name)
        whole.mean[at], whole.spread[at] = model.mean[j], model.spread[j]
    del most, model
    arrays.release()
    return whole


def held_out(key: str) -> Column:
    """Documents that training leaves out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every row: doc_id, lang_pred, score, rejected. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.sliced(batch, "text", SLICE_BYTES):
                langs, scores, rejected = shared.value.judged(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language the model recognises, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.sliced(batch, text, SLICE_BYTES):
                _, _, rejected = shared.value.judged(part.column(text))
                yield part.filter(pc.invert(pa.array(rejected)))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))
