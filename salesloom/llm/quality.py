"""Quality of documents: boosted trees over text statistics, with monotonic constraints.

Statistics of whole texts come from byte and word arrays. Trees are grown on
histograms of at most ``BINS`` bins per statistic with logistic loss. For statistics
in ``DIRECTION`` the score may only fall, or only rise, with the statistic: a split
that breaks this is not taken, and each side keeps to its side of the middle value
further down. The trees are then flattened into arrays of nodes, and a batch of
documents walks down all trees at once.

Fitting uses at most ``SAMPLE_ROWS`` labelled documents, chosen by hash of the id;
scoring covers every document. A document is kept when it passes the base rules and
its probability of good quality is at least ``KEEP``.

Words are runs of characters other than space and ``\\x09`` to ``\\x0D``, in their own
case. Defined results: a null or blank text has no words, fails the base rules and is
not kept. Where no label can be used, the base rules alone decide. Labels of one id
that disagree are left out, and so are null labels and ids. Repeated rows are judged
row by row. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays

SAMPLE_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE = 80, 4, 0.15
LEAST_ROWS, SMOOTHING = 10, 1.0
KEEP = 0.5
RUN = 5

SYMBOLS = b"#*$%&|<>"
# +1: the score may only rise with the statistic, -1: only fall, 0: free.
DIRECTION = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "words_with_symbol": -1,
    "upper_share": -1,
    "digit_share": 0,
    "exclaimed_words": -1,
    "stops_per_word": 0,
    "duplicate_lines": -1,
    "words_per_line": 0,
    "repeated_words": -1,
    "distinct_words": 1,
    "doubled_words": -1,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(SYMBOLS)
_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_DIGIT, _STOP = _table(b"0123456789"), _table(b".!?")


def _between(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring places."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def duplicate_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines)), len(lines)


def repeated_words(hashes: np.ndarray, starts: np.ndarray, size: int = RUN) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more."""
    counts = np.diff(starts)
    runs, begins = arrays.shingles(hashes, starts, size)
    owner = np.repeat(np.arange(len(counts)), np.diff(begins))
    full = counts[owner] >= size
    owner, runs = owner[full], runs[full]
    place = np.flatnonzero(full)
    first = starts[owner] + place - begins[owner]
    keyed = arrays.mix(runs + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    twice = np.zeros(len(keyed), dtype=bool)
    twice[order] = same | np.concatenate([same[1:], [False]])
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + size, -1)
    return _between(np.cumsum(edge[:-1]) > 0, starts)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and the matrix of statistics by ``DIRECTION``."""
    flat, starts = arrays.words(texts)
    raw, at = arrays.string_bytes(flat)
    n = np.diff(starts)
    hashes = arrays.word_hashes(flat)
    lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], dtype=np.int64).reshape(-1, 2)
    by_text = at[starts]
    count = lambda table: _between(table[raw], by_text)
    flagged = lambda table: _between(_between(table[raw], at) > 0, starts)
    word_chars = _between((raw & 0xC0) != 0x80, by_text)
    base = {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": count(_SYMBOL),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeated_words(hashes, starts),
    }
    owner = np.repeat(np.arange(len(n)), n)
    last = raw[at[1:] - 1] if len(hashes) else np.zeros(0, dtype=np.uint8)
    keyed = arrays.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(keyed), dtype=bool)
    new[order[1:]] = keyed[order[1:]] != keyed[order[:-1]]
    doubled = np.zeros(len(keyed), dtype=bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper, lower = count(_UPPER), count(_LOWER)
    safe = np.maximum(n, 1)
    columns = [
        np.log1p(n),
        word_chars / safe,
        base["n_symbols"] / safe,
        flagged(_SYMBOL) / safe,
        upper / np.maximum(upper + lower, 1),
        count(_DIGIT) / np.maximum(word_chars, 1),
        _between(last == 33, starts) / safe,
        _between(_STOP[last], starts) / safe,
        base["n_dup_lines"] / np.maximum(lines[:, 1], 1),
        n / np.maximum(lines[:, 1], 1),
        base["n_repeat_words"] / safe,
        _between(new, starts) / safe,
        _between(doubled, starts) / safe,
    ]
    return base, np.stack(columns, axis=1).astype(np.float64)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than 10 words, or more than a fifth of them repeated."""
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


@dataclass
class Trees:
    """All trees in arrays of nodes; a leaf is its own child on both sides."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.bound[node]
            node = np.where(low, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


class _Grower:
    def __init__(self, x: np.ndarray, signs: np.ndarray):
        self.signs = signs
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.binned = np.stack(
            [np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1
        )
        self.nodes: list[list] = []

    def leaf(self, value: float) -> int:
        at = len(self.nodes)
        self.nodes.append([0, np.inf, at, at, value])
        return at

    def grow(self, rows, slope, curve, depth, low, high) -> int:
        g, h = slope[rows].sum(), curve[rows].sum()
        value = float(np.clip(-g / (h + SMOOTHING), low, high))
        best = None
        if depth and len(rows) >= 2 * LEAST_ROWS:
            best = self._best_split(rows, slope, curve, g, h, low, high)
        if best is None:
            return self.leaf(RATE * value)
        _, feature, cut, left_value, right_value = best
        middle = (left_value + right_value) / 2
        sign = self.signs[feature]
        goes = self.binned[rows, feature] <= cut
        bounds = [(low, high), (low, high)]
        if sign > 0:
            bounds = [(low, middle), (middle, high)]
        elif sign < 0:
            bounds = [(middle, high), (low, middle)]
        at = len(self.nodes)
        self.nodes.append(None)
        sides = [
            self.grow(rows[part], slope, curve, depth - 1, *limits)
            for part, limits in zip((goes, ~goes), bounds, strict=True)
        ]
        self.nodes[at] = [feature, float(self.edges[feature][cut]), *sides, 0.0]
        return at

    def _best_split(self, rows, slope, curve, g, h, low, high):
        best, least_gain = None, 1e-6
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            bins = self.binned[rows, f]
            size = len(edges) + 1
            n = np.bincount(bins, minlength=size).cumsum()[:-1]
            gl = np.bincount(bins, slope[rows], minlength=size).cumsum()[:-1]
            hl = np.bincount(bins, curve[rows], minlength=size).cumsum()[:-1]
            left = np.clip(-gl / (hl + SMOOTHING), low, high)
            right = np.clip(-(g - gl) / (h - hl + SMOOTHING), low, high)
            gain = _gain(gl, hl, left) + _gain(g - gl, h - hl, right)
            fits = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS)
            fits &= self.signs[f] * (right - left) >= 0
            if not fits.any():
                continue
            own = np.clip(-g / (h + SMOOTHING), low, high)
            gain = np.where(fits, gain - _gain(g, h, own), -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > least_gain:
                least_gain = gain[cut]
                best = (gain[cut], f, cut, float(left[cut]), float(right[cut]))
        return best


def _gain(g, h, value):
    return -(2 * g * value + (h + SMOOTHING) * value * value)


def fit(x: np.ndarray, good: np.ndarray, signs: np.ndarray | None = None) -> Trees | None:
    """Boosted trees for the probability of ``good``; None without both classes."""
    signs = np.array(list(DIRECTION.values())) if signs is None else signs
    if not len(good) or good.all() or not good.any():
        return None
    share = good.mean()
    start = float(np.log(share / (1 - share)))
    grower, roots = _Grower(x, signs), []
    score = np.full(len(good), start)
    rows = np.arange(len(good))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        first = len(grower.nodes)
        roots.append(grower.grow(rows, p - good, p * (1 - p), DEPTH, -np.inf, np.inf))
        one = _flat(grower.nodes[first:], [0], 0.0, first)
        score += np.log(one.probability(x) / (1 - one.probability(x)))
    return _flat(grower.nodes, roots, start)


def _flat(nodes: list[list], roots: list[int], start: float, shift: int = 0) -> Trees:
    feature, bound, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(feature, bound, left - shift, right - shift, value, np.array(roots), DEPTH, start)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.sliced(batch, "text"):
            _, x = statistics(part.column("text"))
            bounds = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            listed = pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("quality"), listed], names=["quality", "x"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Trees | None:
    """Fit on the documents of at most ``sample_rows`` labelled ids."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("quality", "text")
    found = rows.mapInArrow(_sampled, "quality int, x array<double>").limit(2 * sample_rows).toArrow()
    if not found.num_rows:
        return None
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(found.num_rows, -1)
    order = np.lexsort([*x.T, found.column("quality").to_numpy()])  # the same for any order of rows
    return fit(x[order], found.column("quality").to_numpy()[order].astype(float) > 0)


def judge(
    docs: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text", keep: float = KEEP
) -> DataFrame:
    """Each row: doc_id, the base counts, base_failed, probability, kept. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.sliced(batch, "text"):
                base, x = statistics(part.column("text"))
                failed = base_failed(base)
                good = np.ones(len(x)) if shared.value is None else shared.value.probability(x)
                columns = [part.column("doc_id"), *(pa.array(base[c], pa.int64()) for c in BASE)]
                columns += [pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *BASE, "base_failed", "probability", "kept"]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in BASE)
    return rows.mapInArrow(
        work, f"doc_id {kind}, {counts}, base_failed boolean, probability double, kept boolean"
    )
