"""Benchmark decontamination: BM25 retrieval of test items for every passage.

Of question and answer of a test item (the text up to the first line break, and what
follows) the longer one is cut into entries of at most ``ENTRY_WORDS`` words, indexed by
term: both must be confirmed, so one is enough to retrieve the item.
Every document is read as passages of ``PASSAGE_WORDS`` words that start every half
passage, so each stretch as long as an entry lies in one passage as a whole. A passage
is a query of its distinct words. It retrieves all entries that reach the score they
need. Three bounds come before the scores, as in WAND with
block maxima: the sum of the terms' largest shares, the same with each term once, and
for each block of entries the sum of the terms' largest shares in that block. All are
upper bounds, so nothing above the threshold is lost.

The needed score follows from ``OVERLAP``. In a part that reaches it, at most the other
share of the five-word runs is missing. A word is uncovered only if all runs with it
are, which costs a run for each such word at least, so the part lacks no more words than
runs and one of its entries at most an equal share of them. The entry needs its own
score without that many of its heaviest terms. So an item is retrieved wherever the
words of an entry that the document holds lie in one passage. Runs strewn over longer
stretches may fail to retrieve it.

A retrieved item is confirmed on the whole document: at least ``OVERLAP`` of the
five-word runs of its question and of its answer must occur. A part without words asks
nothing, and a part of fewer than five words counts as one run.

The index is built by Spark over all items and used in shards of at most
``SHARD_WORDS`` words (or one longer item), each broadcast for one pass over the
documents. Words are runs of characters other than white space, A to Z in lower case.

With ``bare`` words lose the signs before their first and after their last letter, mark
or digit, words of signs only go, and an item of fewer than ``LEAST_WORDS`` words is asked
for as one phrase. With ``in_order`` (the stage of the pipeline) a part of fewer than
``FEW_WORDS`` words then also counts with the share of its words that stand in order
beside a match of the other part.

Defined results: items with a null text or (without ``bare``) fewer than ``LEAST_WORDS``
words match nothing, nor do null or blank documents. Repeated rows and ids are answered row by
row, equal items each with their own id. Empty tables give empty results, or leave
all documents. Other columns do not matter and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm import arrays
from salesloom.workspace import stage

ENTRY_WORDS, PASSAGE_WORDS = 32, 64
OVERLAP = 0.8
LEAST_WORDS, RUN = 5, 5
FEW_WORDS = 10
SIGNS = r"^[^\pL\pM\pN]+|[^\pL\pM\pN]+$"
K1, B = 1.2, 0.75
BLOCK = 8
SHARD_WORDS = 1_000_000


def _hashes(texts: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words start."""
    flat, starts = arrays.words(texts, lower=True)
    if not bare:
        return arrays.word_hashes(flat), starts
    coded = flat.dictionary_encode()
    own = pc.replace_substring_regex(coded.dictionary, SIGNS, "")
    place = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(own).to_numpy(zero_copy_only=False) > 0)[place]
    before = np.concatenate([[0], np.cumsum(real)])
    return arrays.word_hashes(own)[place[real]], before[starts]


def _needed(words: np.ndarray, overlap: float) -> list[tuple[np.ndarray, int]]:
    """Entries of a part, and how many words each may lack."""
    if not len(words):
        return []
    size = min(RUN, len(words))
    runs = len(np.unique(arrays.shingles(words, np.array([0, len(words)]), size)[0]))
    missing = int((1 - overlap) * runs + 1e-9)
    entries = np.array_split(words, -(-len(words) // ENTRY_WORDS))
    return [(own, missing // len(entries)) for own in entries]


def _sought(parts: list[np.ndarray], in_order: bool) -> list[np.ndarray]:
    """The parts whose entries retrieve an item.

    Both parts must be confirmed, so the longer one is enough, as it is rarer. With
    ``in_order`` a short part may count without its runs, but then the other one has them.
    """
    longest = max(parts, key=len)
    return parts if in_order and len(longest) < FEW_WORDS else [longest]


def _entries(bare: bool, overlap: float, in_order: bool):
    """Terms of the entries of each item: number within the item, length, frequencies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = _words_of(text, bare)
                if not bare and sum(map(len, parts)) < LEAST_WORDS:
                    continue
                sought = _sought(parts, in_order)
                entries = [e for words in sought for e in _needed(words, overlap)]
                for n, (own, spare) in enumerate(entries):
                    terms, counts = np.unique(own, return_counts=True)
                    rows.append((i, n, len(own), spare, terms, counts))
            sizes = [len(r[4]) for r in rows]
            column = lambda k: np.repeat([r[k] for r in rows], sizes).astype(np.int64)
            terms = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.uint64)
            counts = np.concatenate([r[5] for r in rows]) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item").take(pa.array(column(0))),
                    *(pa.array(column(k)) for k in (1, 2, 3)),
                    pa.array(terms.view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["item", "entry", "size", "spare", "term", "n"],
            )

    return work


@dataclass
class Index:
    """Inverted index of a shard of items, by sorted term hash."""

    item_ids: list
    entry_item: np.ndarray  # number of the item of each entry
    terms: np.ndarray
    begin: np.ndarray  # first posting of each term, n + 1 numbers
    entry: np.ndarray  # entry of each posting, rising within a term
    share: np.ndarray  # part of the entry's needed score that the term gives
    top: np.ndarray  # largest share of each term
    block_begin: np.ndarray  # first block row of each term, n + 1 numbers
    block: np.ndarray
    block_top: np.ndarray
    block_posting: np.ndarray  # first posting of each block row, n + 1 numbers
    # Of question and answer: run size, distinct runs, words; empty without words.
    parts: list[list[tuple[int, np.ndarray, np.ndarray] | None]] = field(default_factory=list)
    bare: bool = False


def _part(words: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    size = min(RUN, len(words))
    if not size:
        return None
    return size, np.unique(arrays.shingles(words, np.array([0, len(words)]), size)[0]), words


def _words_of(text: str, bare: bool) -> list[np.ndarray]:
    """Hashes of the words of question and answer; all in one for an item of few words."""
    question, _, answer = text.partition("\n")
    own = [_hashes(pa.array([t]), bare)[0] for t in (question, answer)]
    whole = np.concatenate(own)
    return [whole, whole[:0]] if len(whole) < LEAST_WORDS else own


def _parts(text: str, bare: bool) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
    return [_part(words) for words in _words_of(text, bare)]


def build_index(items: pa.Table, postings: pa.Table, bare: bool = False) -> Index:
    """``items``: item, item_id, text; ``postings``: item, entry, term, weight, needed."""
    listed = items.column("item").to_pylist()
    number = {x: i for i, x in enumerate(listed)}
    item = np.array([number[x] for x in postings.column("item").to_pylist()], dtype=np.int64)
    entry = postings.column("entry").to_numpy()
    pair, entries = np.unique(np.stack([item, entry], axis=1), axis=0, return_inverse=True)
    entries = entries.reshape(-1)
    term = postings.column("term").to_numpy().view(np.uint64)
    share = postings.column("weight").to_numpy() / postings.column("needed").to_numpy()
    order = np.lexsort((entries, term))
    term, entries, share = term[order], entries[order], share[order]
    terms, begin = np.unique(term, return_index=True)
    begin = np.append(begin, len(term))
    block = entries // BLOCK
    place = np.repeat(np.arange(len(terms)), np.diff(begin))
    new = np.ones(len(term), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    texts = items.column("text").to_pylist()
    parts = [_parts(text, bare) for text in texts]
    reduced = np.maximum.reduceat if len(term) else (lambda x, _: x)
    return Index(
        items.column("item_id").to_pylist(),
        pair[:, 0],
        terms,
        begin,
        entries,
        share,
        reduced(share, begin[:-1]),
        np.searchsorted(place[first], np.arange(len(terms) + 1)),
        block[first],
        reduced(share, first),
        np.append(first, len(term)),
        parts,
        bare,
    )


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers begin[i] ... begin[i] + count[i] - 1 for all i, and the i of each."""
    owner = np.repeat(np.arange(len(begin)), count)
    return np.arange(len(owner)) + np.repeat(begin - (np.cumsum(count) - count), count), owner


def retrieve(
    index: Index, hashes: np.ndarray, starts: np.ndarray, share: float = 1.0
) -> list[tuple[int, int, float]]:
    """(text, item, best share) for all items that a passage of the text retrieves.

    Shares are multiples of the score that an entry needs.
    """
    if not len(index.terms) or not len(hashes):
        return []
    half = PASSAGE_WORDS // 2
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == hashes)
    counts = np.diff(starts)
    halves = -(-counts // half)
    first_half = np.concatenate([[0], np.cumsum(halves)])
    text = np.searchsorted(starts, hit, side="right") - 1
    own = first_half[text] + (hit - starts[text]) // half
    term = at[hit]
    # Bound with repeats: passage h holds the halves h and h + 1 of one text.
    gain = np.bincount(own, index.top[term], minlength=first_half[-1] + 1)
    follows = np.ones(first_half[-1], dtype=bool)
    follows[first_half[1:][halves > 0] - 1] = False
    bound = gain[:-1] + np.where(follows, gain[1:], 0)
    alive = bound >= share - 1e-9
    if not alive.any():
        return []
    # Each term once in a passage.
    before = np.concatenate([[False], follows[:-1]])
    in_own, in_last = alive[own], before[own] & np.concatenate([[False], alive[:-1]])[own]
    n = len(index.terms)
    keys = np.unique(
        np.concatenate([own[in_own] * n + term[in_own], (own[in_last] - 1) * n + term[in_last]])
    )
    passage, term = keys // n, keys % n
    bound = np.bincount(passage, index.top[term], minlength=first_half[-1])
    keep = bound[passage] >= share - 1e-9
    passage, term = passage[keep], term[keep]
    # Bound for each block of entries.
    rows, owner = _spread(index.block_begin[term], np.diff(index.block_begin)[term])
    blocks = int(index.entry.max()) // BLOCK + 1
    spot, place = np.unique(passage[owner] * blocks + index.block[rows], return_inverse=True)
    bound = np.bincount(place, index.block_top[rows], minlength=len(spot))
    keep = bound[place] >= share - 1e-9
    rows, owner = rows[keep], owner[keep]
    # Scores of the entries of what is left.
    posts, row = _spread(index.block_posting[rows], np.diff(index.block_posting)[rows])
    total = int(index.entry.max()) + 1
    spot, place = np.unique(passage[owner][row] * total + index.entry[posts], return_inverse=True)
    score = np.bincount(place, index.share[posts], minlength=len(spot))
    found = np.flatnonzero(score >= share - 1e-9)
    best: dict[tuple[int, int], float] = {}
    texts = np.searchsorted(first_half, spot[found] // total, side="right") - 1
    for t, i, s in zip(
        texts.tolist(), index.entry_item[spot[found] % total].tolist(), score[found].tolist(), strict=True
    ):
        best[(t, i)] = max(best.get((t, i), 0.0), s)
    return [(t, i, s) for (t, i), s in sorted(best.items())]


def _in_order(wanted: np.ndarray, have: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    best = np.zeros(len(have) + 1, dtype=np.int64)
    for word in wanted:
        step = np.where(have == word, best[:-1] + 1, best[1:])
        best[1:] = np.maximum.accumulate(step)
    return int(best[-1])


def _beside(words: np.ndarray, wanted: np.ndarray, other: tuple, at: np.ndarray, after: bool) -> float:
    """Largest share of the wanted words in order, after or before a match of the other part.

    ``at`` has the places of the other part's runs. A stretch is twice as long as the
    wanted part, and longer by what may lack at the other part's end.
    """
    size, runs, own = other
    reach = 2 * len(wanted) + len(own) - int(OVERLAP * len(own))
    gap = np.diff(at) > size
    if after:
        begins = at[np.append(gap, True)] + size
        ends = begins + reach
    else:
        ends = at[np.insert(gap, 0, True)]
        begins = np.maximum(ends - reach, 0)
    best = 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        best = max(best, _in_order(wanted, words[a:b]))
        if best == len(wanted):
            break
    return best / len(wanted)


def _confirmed(index: Index, part: pa.RecordBatch, overlap: float, in_order: bool) -> list[tuple]:
    """(row, item number, share, question overlap, answer overlap) of confirmed matches."""
    hashes, starts = _hashes(part.column("text"), index.bare)
    rows, runs = [], {}
    for row, item, score in retrieve(index, hashes, starts):
        words = hashes[starts[row] : starts[row + 1]]
        shares = []
        for wanted in index.parts[item]:
            if wanted is None:
                shares.append(None)
                continue
            size, own, _ = wanted
            if (row, size) not in runs:
                runs[(row, size)] = arrays.shingles(words, np.array([0, len(words)]), size)[0]
            shares.append(float(np.isin(own, runs[(row, size)]).mean()))
        if in_order and None not in shares and max(shares) >= overlap > min(shares):
            low = int(shares[1] < overlap)
            wanted, other = index.parts[item][low], index.parts[item][1 - low]
            if len(wanted[2]) < FEW_WORDS:
                at = np.flatnonzero(np.isin(runs[(row, other[0])], other[1]))
                shares[low] = max(shares[low], _beside(words, wanted[2], other, at, bool(low)))
        if all(s is None or s >= overlap for s in shares):
            rows.append((row, item, score, *shares))
    return rows


def _shards(
    items: DataFrame,
    item_id: str,
    text: str,
    bare: bool = False,
    overlap: float = OVERLAP,
    in_order: bool = False,
) -> Iterator[Index]:
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    rows = rows.where("text is not null").withColumn("item", F.monotonically_increasing_id())
    rows = stage(rows, "items")
    kind = "item long, entry long, size long, spare long, term long, n long"
    terms = stage(rows.select("item", "text").mapInArrow(_entries(bare, overlap, in_order), kind), "postings")
    entries = terms.select("item", "entry", "size").distinct()
    count, mean, words = entries.agg(F.count("*"), F.avg("size"), F.sum("size")).first()
    if not count:
        return
    found = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("size") / F.lit(mean))
    weighted = terms.join(found, "term").withColumn(
        "weight", idf * F.col("n") * (K1 + 1) / (F.col("n") + norm)
    )
    # The rows of an entry are its terms, at most ``ENTRY_WORDS``.
    entry = Window.partitionBy("item", "entry")
    heavy = F.row_number().over(entry.orderBy(F.desc("weight"), "term"))
    needed = F.sum(F.when(F.col("heavy") > F.col("spare"), F.col("weight"))).over(entry)
    weighted = weighted.withColumn("heavy", heavy).withColumn("needed", needed)
    shards = -(-words // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard")
    weighted = stage(weighted.select("item", "entry", "term", "weight", "needed", shard), "weights")
    for number in range(shards):
        postings = weighted.where(F.col("shard") == number).drop("shard")
        used = rows.join(postings.select("item").distinct(), "item")
        yield build_index(used.toArrow(), postings.toArrow(), bare)


def matches(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    overlap: float = OVERLAP,
    bare: bool = False,
    in_order: bool = False,
) -> DataFrame:
    """Confirmed matches: doc_id, item_id, share, question_overlap, answer_overlap.

    The share is the best one of an entry, as a multiple of what it needs. An overlap is null where the item has no such part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType, items.schema[item_id].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("item_id", item_type)]
    names = ("share", "question_overlap", "answer_overlap")
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in names])

    def searched(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in arrays.sliced(batch, "text"):
                    found = _confirmed(shared.value, part, overlap, in_order)
                    if not found:
                        continue
                    at, item, *numbers = zip(*found, strict=True)
                    ids = [shared.value.item_ids[i] for i in item]
                    columns = [part.column("doc_id").take(pa.array(at)), pa.array(ids)]
                    columns += [pa.array(x, pa.float64()) for x in numbers]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(work, schema)

    found = None
    for index in _shards(items, item_id, item_text, bare, overlap, in_order):
        one = searched(index)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    overlap: float = OVERLAP,
    bare: bool = False,
    in_order: bool = False,
) -> DataFrame:
    """The documents that contain no test item, with all their columns. No shuffle."""
    for index in _shards(items, item_id, item_text, bare, overlap, in_order):
        docs = _without(docs, index, text, overlap, in_order)
    return docs


def _without(docs: DataFrame, index: Index, text: str, overlap: float, in_order: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.sliced(batch, text):
                only = pa.RecordBatch.from_arrays([part.column(text)], names=["text"])
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[r[0] for r in _confirmed(shared.value, only, overlap, in_order)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))
