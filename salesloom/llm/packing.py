"""Order-preserving packing: the best cuts of a stream of documents into windows.

Documents follow each other as they are stored. A cut may fall at the end of a
document (free), of a sentence (a small penalty) or inside one, every ``STRIDE`` tokens (a
larger one). Dynamic programming over the allowed cuts takes
the cheapest sum of padding and penalties. Cuts that need the same number of windows
are worked out at once, from the running minimum of those with one window less; where
penalties outweigh a window, a queue kept in rising order of cost gives the same cuts.

A window is padded to ``WINDOW`` tokens unless its length is a power of two. The end
of a lane, a run of about ``LANE_TOKENS`` tokens of one partition, is either padded
or cut into powers of two, whichever costs less.

Defined results: a null, empty or blank text is its final id alone. A text of any
length is cut as often as needed and loses nothing. Repeated rows are packed as often
as they occur, null ids stay null, an empty table gives an empty result, and other
columns are not read. Nothing is shuffled, and a task holds one lane at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays, tokens

WINDOW = 4096
LAST_ID = 2
LANE_TOKENS = 1 << 20
# Penalties count as so many tokens of padding.
SENTENCE_COST, TOKEN_COST = 2, 8
# Cuts between tokens are offered every so many tokens of a sentence.
STRIDE = 16


def offered_cuts(
    bounds: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE
) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, in order, and what a cut there costs."""
    documents = bounds[1:]
    places = np.concatenate([documents, sentence_ends])
    costs = np.repeat([0, SENTENCE_COST], [len(documents), len(sentence_ends)])
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    first = np.concatenate([[True], places[1:] > places[:-1]])
    places, costs = places[first], costs[first]
    begins = np.concatenate([[0], places[:-1]])
    more = (places - begins - 1) // stride
    number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    hard = np.repeat(begins, more) + number * stride
    every = np.concatenate([places, hard])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([costs, np.full(len(hard), TOKEN_COST)])[order]


def end_cost(rest: int, window: int = WINDOW) -> int:
    """Cost of the last tokens: padded, or cut into powers of two."""
    return min(window - rest, TOKEN_COST * rest.bit_count())


def _by_layers(at: np.ndarray, price: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray] | None:
    """What ``_by_queue`` gives, for all cuts that need the same number of windows at once.

    As long as the costs in a layer differ by less than a window, the best earlier cut
    lies in the layer before, and is its cheapest one from some place on. None where
    they differ by more.
    """
    size = len(at)
    best, before = np.zeros(size, np.int64), np.zeros(size, np.int64)
    from_place = np.searchsorted(at, at - window)
    low, high = 0, 1  # the layer before
    while high < size:
        layer = best[low:high]
        if layer.max() - layer.min() >= window:
            return None
        stop = int(np.searchsorted(at, at[high - 1] + window, side="right"))
        # The least cost from each cut on; of equal ones, the last cut.
        rank = (layer * size - np.arange(low, high))[::-1]
        rank = np.minimum.accumulate(rank)[::-1][np.maximum(from_place[high:stop] - low, 0)]
        before[high:stop] = -rank % size
        best[high:stop] = best[before[high:stop]] + window + price[high:stop]
        low, high = high, stop
    return best, before


def _by_queue(at: list[int], price: list[int], window: int) -> tuple[list[int], list[int]]:
    """The cheapest cost up to each cut, plus its place, and the cut before it."""
    best = [0] * len(at)
    before = [0] * len(at)
    queue, head = [0], 0
    for i in range(1, len(at)):
        low = at[i] - window
        while at[queue[head]] < low:
            head += 1
        before[i] = queue[head]
        value = best[queue[head]] + window + price[i]
        best[i] = value
        while len(queue) > head and best[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    return best, before


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows that cost least in all. Neighbouring places are at most a
    window apart, and the last place is the end of the stream."""
    at, price = np.concatenate([[0], places]), np.concatenate([[0], costs])
    found = _by_layers(at, price, window)
    if found is None:
        found = map(np.array, _by_queue(at.tolist(), price.tolist(), window))
    best, before = found
    end, last = int(at[-1]), len(at) - 1
    first = min(int(np.searchsorted(at, end - window)), last - 1)
    near = zip(best[first:last].tolist(), at[first:last].tolist(), range(first, last), strict=True)
    cut = min(near, key=lambda c: (c[0] - c[1] + end_cost(end - c[1], window), -c[2]))[2]
    at = at.tolist()
    rest, tail = end - at[cut], []
    if end_cost(rest, window) < window - rest:
        place = at[cut]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                place += 1 << bit
                tail.append(place)
    else:
        tail = [end]
    cuts = []
    while cut > 0:
        cuts.append(at[cut])
        cut = int(before[cut])
    return cuts[::-1] + tail


def pieces(bounds: np.ndarray, cuts: list[int]) -> dict[str, np.ndarray]:
    """The stretches of documents that lie in one window, in order."""
    ends = np.asarray(cuts, dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.union1d(bounds, ends)
    start = edges[:-1]
    doc = np.searchsorted(bounds, start, side="right") - 1
    window = np.searchsorted(ends, start, side="right")
    return {
        "edges": edges,
        "doc": doc,
        "window": window,
        "start": start - bounds[doc],
        "length": np.diff(edges),
        "doc_tokens": np.diff(bounds)[doc],
        "offset": start - begins[window],
    }


class _Lane:
    """Encoded documents of one partition that wait to be cut."""

    def __init__(self):
        self.ids, self.bounds, self.sentences, self.keys, self.size = [], [], [], [], 0

    def add(self, keys: pa.Array, ids: np.ndarray, bounds: np.ndarray, sentences: np.ndarray):
        self.ids.append(ids)
        self.bounds.append(bounds[1:] + self.size)
        self.sentences.append(sentences + self.size)
        self.keys.append(keys)
        self.size += len(ids)

    def packed(self, window: int, first: int) -> tuple[pa.RecordBatch, int]:
        bounds = np.concatenate([[0], *self.bounds])
        stride = min(STRIDE, window)
        cuts = best_cuts(*offered_cuts(bounds, np.concatenate(self.sentences), stride), window)
        found = pieces(bounds, cuts)
        data = np.concatenate(self.ids).astype("<u4")
        places = pa.array((found["edges"] * 4).astype(np.int32))
        ids = pa.Array.from_buffers(
            pa.binary(), len(found["start"]), [None, places.buffers()[1], pa.py_buffer(data)]
        )
        keys = pa.chunked_array(self.keys).take(pa.array(found["doc"])).combine_chunks()
        columns = [keys, *(pa.array(found[c]) for c in ("start", "length", "doc_tokens"))]
        columns += [pa.array(found["window"] + first), pa.array(found["offset"]), ids]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES), first + len(cuts)


_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    tokenizer: str = tokens.WORD_TOKENIZER,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are unsigned 32-bit little-endian numbers. Pieces of a sequence follow
    each other by ``offset``; the ids of a document end with ``LAST_ID``. Sequence
    ids are unique and follow the order of partitions and rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.trim()
        encode = tokens.encoder(tokenizer).encode
        first, lane = TaskContext.get().partitionId() << 32, _Lane()
        for batch in batches:
            for part in arrays.sliced(batch, "text", tokens.SLICE_BYTES):
                ids, bounds, sentences = encode(part.column("text"), LAST_ID)
                a = 0
                while a < part.num_rows:
                    room = bounds[a] + LANE_TOKENS - lane.size
                    b = max(a + 1, int(np.searchsorted(bounds, room, side="right")) - 1)
                    low, high = bounds[a], bounds[b]
                    s, t = np.searchsorted(sentences, [low, high], side="right")
                    keys = part.column("doc_id").slice(a, b - a)
                    lane.add(keys, ids[low:high], bounds[a : b + 1] - low, sentences[s:t] - low)
                    a = b
                    if a < part.num_rows or lane.size >= LANE_TOKENS:
                        rows, first = lane.packed(window, first)
                        yield rows
                        lane = _Lane()
        if lane.size:
            yield lane.packed(window, first)[0]

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _NAMES[1:-1])
    return rows.mapInArrow(work, f"doc_id {kind}, {numbers}, ids binary")


def padding(length: int, window: int = WINDOW) -> int:
    """Padding of a sequence: none where its length is a power of two."""
    return 0 if length & (length - 1) == 0 else window - length
