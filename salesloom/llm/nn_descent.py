"""Nearest neighbours by inner product: NN-descent graph and greedy graph search.

Equal vectors are one node, with the ids that any answer can need. Nodes get one more
component that brings all of them to the length of the longest, so the largest inner
products of a query are its nearest nodes, and the graph is built by that nearness.

The graph starts from exact neighbours within chunks: nodes with the same signs along
some random directions, several times, and once at random. A chunk holds about ``CHUNK``
nodes; a code that more nodes share is split by hash. Then rounds of NN-descent: the
edges of the graph, forward and backward, are joined with the vectors of their ends and
gathered at the node between them, so neighbours of neighbours meet. A pair that beats
what one of its ends has becomes an edge of it, where at least one of the two edges is
new; the best ``DEGREE`` stay. A node that many others point at gets their edges in
lists of ``DEGREE``, each joined with the node's own neighbours, so no list grows with
the data and no edge is left out. The rounds end when few edges change.

A search starts from the query's own place in the graph and from a few fixed entry
nodes. Each step scores the neighbours of the best nodes not looked at yet, for all
queries at once by joins, until the best ``BEAM`` nodes of a query are all looked at.
Vectors of the graph and the search have half precision; the best ``BEAM`` are scored
again in double precision on the original vectors.

The answer is approximate, and tests measure its recall against all pairs. With few rows
(up to ``DEGREE`` nodes besides the query) it is exact.

Defined results: vectors that are null or zero, or hold a null or non-finite component,
take no part, nor do rows without an id. A shorter vector counts as filled with zeros.
Rows equal in id and vector are one row. Where an id has several vectors, each is
searched, the best score counts, and the id is none of its own neighbours. Ties go to
smaller ids. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.workspace import stage

SEED = 20250711
NEIGHBOURS = 20
# Edges of a node in the graph; nodes of a chunk of the first graph, and how many times
# nodes are put in chunks.
DEGREE, CHUNK, CODES = 48, 1024, 8
MOST_BITS = 32
# Rounds end when a round changes less than this share of the edges.
STILL, MOST_ROUNDS = 0.02, 8
# Nodes a search keeps, how many it looks at in a step, and fixed entry nodes.
BEAM, STEP, ENTRIES = 96, 32, 8
# Lists that are worked on at once.
LISTS = 64

Groups = Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(
        numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return vector.isNotNull() & ~bad & F.exists(numbers, lambda x: x != 0)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, cut or filled with zeros to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out[:, :width]


def _halves(rows: np.ndarray) -> pa.Array:
    """Each row as half-precision numbers in a binary value."""
    raw = np.ascontiguousarray(rows.astype(np.float16))
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * 2)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )


def _numbers(values: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of single-precision numbers."""
    if not len(values):
        return np.zeros((0, 0), dtype=np.float32)
    at = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    return raw.view(np.float16).reshape(len(values), -1).astype(np.float32)


def _embedded(width: int, longest: float, bits: int) -> Callable:
    """Half-precision vectors of one length, and codes of the signs along random directions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((CODES, width + 1, bits))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), width) / longest
            rest = np.sqrt(1.0 - np.minimum((x * x).sum(axis=1), 1.0))
            filled = np.column_stack([x, rest])
            codes = np.zeros((len(x), CODES), dtype=np.int64)
            for c in range(CODES):
                codes[:, c] = ((filled @ planes[c]) > 0) @ (1 << np.arange(bits))
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * CODES, pa.int32()), pa.array(codes.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), _halves(filled), listed], names=["node", "half", "codes"]
            )

    return work


def _as_queries(width: int) -> Callable:
    """Half-precision unit vectors of queries; the component that fills them up is 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), width)
            for size in (np.abs(x).max(axis=1), np.linalg.norm(x, axis=1)):
                x /= np.where(size > 0, size, 1.0)[:, None]
            filled = np.column_stack([x, np.zeros(len(x))])
            yield pa.RecordBatch.from_arrays([batch.column("q"), _halves(filled)], names=["q", "half"])

    return work


def grouped(keys: list[str], work: Groups) -> Callable:
    """A task over rows that are sorted by ``keys``, in batches of whole groups.

    ``work`` gets the rows of some groups and where each group starts (n + 1 numbers).
    """

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            at = starts(both)
            if at[-1] > 0:
                yield work(both.slice(0, int(at[-1])), at)
            held = [both.slice(int(at[-1]))]
        if held:
            yield work(held[0], np.array([0, held[0].num_rows]))

    return run


def _best(u: np.ndarray, v: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    """The ``most`` best different v of each u."""
    order = np.lexsort((v, -score, u))
    u, v, score = u[order], v[order], score[order]
    once = np.ones(len(u), dtype=bool)
    pair = np.lexsort((v, u))
    once[pair[1:]] = (u[pair[1:]] != u[pair[:-1]]) | (v[pair[1:]] != v[pair[:-1]])
    u, v, score = u[once], v[once], score[once]
    first = np.searchsorted(u, u, side="left")
    keep = np.arange(len(u)) - first < most
    return pa.RecordBatch.from_arrays(
        [pa.array(u[keep]), pa.array(v[keep]), pa.array(score[keep])], names=["u", "v", "score"]
    )


def _in_chunk(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
    """The nearest ``DEGREE`` nodes of each node within its chunk."""
    nodes = batch.column("node").to_numpy(zero_copy_only=False)
    vectors = _numbers(batch.column("half"))
    found = []
    for a, b in zip(at, at[1:], strict=False):
        for s in range(a, b, CHUNK):
            e = min(s + CHUNK, b)
            scores = vectors[s:e] @ vectors[a:b].T
            scores[np.arange(e - s), np.arange(s - a, e - a)] = -np.inf
            most = min(DEGREE, b - a - 1)
            if not most:
                continue
            near = np.argpartition(scores, -most, axis=1)[:, -most:]
            found.append(
                (
                    np.repeat(nodes[s:e], most),
                    nodes[a:b][near.ravel()],
                    np.take_along_axis(scores, near, axis=1).ravel(),
                )
            )
    if not found:
        return _best(nodes[:0], nodes[:0], np.zeros(0, np.float32), DEGREE)
    return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), DEGREE)


def _with_last(at: np.ndarray, rows: int) -> np.ndarray:
    return at if len(at) and at[-1] == rows else np.append(at, rows)


def _meetings(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
    """Pairs of members of a list that beat the worst edge of one of them.

    A member that comes both ways is one, new if either edge is: it comes first.
    """
    member = batch.column("m").to_numpy(zero_copy_only=False)
    again = np.zeros(len(member), dtype=bool)
    again[1:] = member[1:] == member[:-1]
    again[at[:-1]] = False
    batch = batch.filter(pa.array(~again))
    at = np.concatenate([[0], np.cumsum(~again)])[at]
    node = batch.column("m").to_numpy(zero_copy_only=False)
    worst = batch.column("worst").to_numpy(zero_copy_only=False)
    new = batch.column("new").to_numpy(zero_copy_only=False).astype(bool)
    vectors = _numbers(batch.column("half"))
    sizes = np.diff(at)
    found = []
    for s in range(0, len(sizes), LISTS):
        own = sizes[s : s + LISTS]
        place = np.arange(own.max()) < own[:, None]
        rows = np.where(place, at[s : s + LISTS][: len(own), None] + np.arange(own.max()), 0)
        x = vectors[rows]
        scores = x @ x.transpose(0, 2, 1)
        fresh = new[rows] & place
        either = (fresh[:, :, None] | fresh[:, None, :]) & place[:, :, None] & place[:, None, :]
        ids = node[rows]
        either &= ids[:, :, None] != ids[:, None, :]
        either &= scores > worst[rows][:, :, None]
        i, j, k = np.nonzero(either)
        found.append((ids[i, j], ids[i, k], scores[i, j, k]))
    return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), DEGREE)


# Rows of a search step: the query's vector, its beam so far, candidates.
QUERY, HELD, CANDIDATE = 0, 1, 2
STATE = "q long, w long, score float, looked boolean, ahead boolean, open boolean"


def _stepped(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
    """The new beam of each query: candidates scored, the best ``BEAM`` nodes kept, and the
    best of those not looked at marked as the next ones. ``open`` tells whether there are any.
    """
    kind = batch.column("kind").to_numpy(zero_copy_only=False)
    q, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("q", "w"))
    held = pa.array(kind == HELD)
    score = np.zeros(len(q), dtype=np.float32)
    looked = np.zeros(len(q), dtype=bool)
    score[kind == HELD] = batch.column("score").filter(held).to_numpy(zero_copy_only=False)
    looked[kind == HELD] = batch.column("looked").filter(held).to_numpy(zero_copy_only=False)
    vectors = _numbers(batch.column("half").filter(pa.array(kind != HELD)))
    place = np.cumsum(kind != HELD) - 1
    rows, ahead, still = [], [], []
    for a, b in zip(at, at[1:], strict=False):
        if b - a < 2:
            continue
        old = np.arange(a, b)[kind[a:b] == HELD]
        new = np.arange(a, b)[kind[a:b] == CANDIDATE]
        new = new[~np.isin(w[new], w[old])]
        score[new] = vectors[place[new]] @ vectors[place[a]]
        both = np.concatenate([old, new])
        best = both[np.lexsort((w[both], -score[both]))[:BEAM]]
        follow = np.flatnonzero(~looked[best])[:STEP]
        chosen = np.zeros(len(best), dtype=bool)
        chosen[follow] = True
        rows.append(best)
        ahead.append(chosen)
        still.append(np.full(len(best), len(follow) > 0))
    rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    ahead = np.concatenate(ahead) if ahead else np.zeros(0, dtype=bool)
    still = np.concatenate(still) if still else np.zeros(0, dtype=bool)
    columns = [q[rows], w[rows], score[rows], looked[rows] | ahead, ahead, still]
    names = ["q", "w", "score", "looked", "ahead", "open"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


EDGE = "u long, v long, score float"


@dataclass
class Index:
    """Tables of an index, and what its vectors have in common.

    ``nodes`` (node, vec, ids) has the distinct vectors with their smallest ids, ``coded``
    (node, half) their form in the graph, ``graph`` (v, w) the nodes to look at from a node.
    """

    nodes: DataFrame
    coded: DataFrame
    graph: DataFrame
    width: int
    entries: list[int]


def _chunks(coded: DataFrame) -> DataFrame:
    """(chunk, node, half): each node once by each code of signs and once at random."""
    codes = F.concat("codes", F.array(F.lit(0).cast("long")))
    rows = coded.select("node", F.posexplode(codes).alias("turn", "code"))
    sizes = rows.groupBy("turn", "code").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    placed = rows.join(sizes, ["turn", "code"])
    part = F.pmod(F.xxhash64("node", "turn"), F.col("parts"))
    placed = placed.select("node", F.xxhash64("turn", "code", part).alias("chunk"))
    return placed.join(coded.select("node", "half"), "node")


def _merged(edges: DataFrame) -> DataFrame:
    """The best ``DEGREE`` edges of each node: u, v, score, new."""
    once = edges.repartition("u").groupBy("u", "v").agg(
        F.max("score").alias("score"), F.min("new").alias("new")
    )
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEGREE).drop("rank")


def _lists(edges: DataFrame) -> DataFrame:
    """(v, part, m, new): the members that meet at v, in lists of a bounded size."""
    into = edges.groupBy("v").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("parts"))
    backward = edges.join(into, "v").select(
        "v",
        F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"),
        F.col("u").alias("m"),
        "new",
    )
    own = edges.select(F.col("u").alias("v"), F.col("v").alias("m"), "new")
    own = own.join(into, "v", "left").select(
        "v",
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
        "m",
        "new",
    )
    return own.unionByName(backward)


def build_graph(coded: DataFrame) -> DataFrame:
    """Edges (u, v, score) from each node to its nearest ones, by NN-descent."""
    ordered = _chunks(coded).repartition("chunk").sortWithinPartitions("chunk")
    first = ordered.mapInArrow(_each(["chunk"], _in_chunk), EDGE)
    edges = stage(_merged(first.withColumn("new", F.lit(True))), "edges")
    total = edges.count()
    for _ in range(MOST_ROUNDS):
        limits = edges.groupBy("u").agg(
            F.when(F.count("*") >= DEGREE, F.min("score"))
            .otherwise(F.lit(float("-inf")))
            .cast("float")
            .alias("worst")
        )
        members = coded.select("node", "half").join(limits, F.col("node") == F.col("u"))
        lists = _lists(edges)
        lists = lists.join(members.select(F.col("node").alias("m"), "half", "worst"), "m")
        lists = lists.repartition("v", "part").sortWithinPartitions("v", "part", "m", F.desc("new"))
        better = lists.mapInArrow(_each(["v", "part"], _meetings), EDGE)
        everything = edges.withColumn("new", F.lit(False)).unionByName(
            better.withColumn("new", F.lit(True))
        )
        edges = stage(_merged(everything), "edges")
        if edges.where("new").count() <= STILL * total:
            break
    return edges.drop("new")


def _each(keys: list[str], work: Groups) -> Callable:
    return grouped(keys, lambda batch, at: work(batch, _with_last(at, batch.num_rows)))


def usable_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    rows = table.select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).distinct()


def build(table: DataFrame, key: str, vector: str) -> Index:
    """Index of all usable rows of a table."""
    rows = usable_rows(table, key, vector)
    order = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS + 1)
    few = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    square = F.aggregate(
        "vec", F.lit(0.0), lambda held, x: held + x.cast("double") * x.cast("double")
    )
    few = few.withColumns({"node": F.monotonically_increasing_id(), "norm": F.sqrt(square)})
    nodes = stage(few, "nodes")
    width, longest, count = nodes.agg(F.max(F.size("vec")), F.max("norm"), F.count("*")).first()
    width, longest = width or 1, longest or 1.0
    entries = nodes.orderBy(F.desc("norm"), "node").limit(ENTRIES).select("node").collect()
    bits = min(MOST_BITS, max(0, int(np.ceil(np.log2(max(count, 1) / CHUNK)))))
    kind = "node long, half binary, codes array<long>"
    coded = nodes.select("node", "vec").mapInArrow(_embedded(width, longest, bits), kind)
    coded = stage(coded, "coded")
    graph = stage(_searchable(build_graph(coded)), "graph")
    return Index(nodes.drop("norm"), coded.drop("codes"), graph, width, [r.node for r in entries])


def _searchable(edges: DataFrame) -> DataFrame:
    """Forward edges, and the best ``DEGREE`` of those that lead to a node."""
    order = Window.partitionBy("v").orderBy(F.desc("score"), "u")
    back = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEGREE)
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("w")).unionByName(
        back.select("v", F.col("u").alias("w"))
    )
    return both.distinct()


def _step(state: DataFrame | None, candidates: DataFrame, queries: DataFrame, coded: DataFrame) -> DataFrame:
    """The next state of the queries that ``state`` holds, with candidates (q, w)."""
    near = candidates.join(coded, F.col("w") == F.col("node"))
    near = near.select("q", F.lit(CANDIDATE).alias("kind"), "w", "half")
    rows = near.unionByName(
        queries.select("q", F.lit(QUERY).alias("kind"), F.lit(-1).cast("long").alias("w"), "half")
    ).withColumns({"score": F.lit(None).cast("float"), "looked": F.lit(None).cast("boolean")})
    if state is not None:
        held = state.select(
            "q", F.lit(HELD).alias("kind"), "w", F.lit(None).cast("binary").alias("half"), "score", "looked"
        )
        rows = rows.unionByName(held)
    ordered = rows.repartition("q").sortWithinPartitions("q", "kind", "w")
    return stage(ordered.mapInArrow(_each(["q"], _stepped), STATE), "state")


def _searched(index: Index, queries: DataFrame) -> DataFrame:
    """(q, node): the best ``BEAM`` nodes of each query (q, vec) that a greedy search finds.

    A query whose beam is looked at leaves the tables of the next steps.
    """
    own = queries.join(index.nodes.select("vec", "node"), "vec").select("q", "node")
    kind = "q long, half binary"
    coded = stage(queries.select("q", "vec").mapInArrow(_as_queries(index.width), kind), "queries")
    entries = F.array(*[F.lit(e).cast("long") for e in index.entries]).cast("array<long>")
    near = own.select("q", F.col("node").alias("w"))
    near = near.unionByName(
        own.join(index.graph, F.col("node") == F.col("v")).select("q", "w")
    ).unionByName(queries.select("q", F.explode(entries).alias("w")))
    state = found = None
    while True:
        state = _step(state, near.distinct(), coded, index.coded)
        ended = state.where("not open").select("q", F.col("w").alias("node"))
        found = ended if found is None else found.unionByName(ended)
        state = state.where("open")
        if state.isEmpty():
            return found
        near = state.where("ahead").select("q", F.col("w").alias("v"))
        near = near.join(index.graph, "v").select("q", "w")


def _exact(width: int) -> Callable:
    """Inner products in double precision: q, ids, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), width) for c in ("vec", "own"))
            scores = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("ids"), pa.array(scores)], names=["q", "ids", "score"]
            )

    return work


def search(index: Index, queries: DataFrame, key: str, vector: str, most: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, id, score: the ``most`` nearest rows found, other than the query's id."""
    rows = stage(usable_rows(queries, key, vector), "query_rows")
    asked = rows.select("vec").distinct().withColumn("q", F.monotonically_increasing_id())
    asked = stage(asked, "asked")
    found = _searched(index, asked).join(index.nodes, "node")
    found = found.join(asked.select("q", F.col("vec").alias("own")), "q")
    found = found.select("q", "ids", "vec", "own")
    ids = index.nodes.schema["ids"].dataType.simpleString()
    scored = found.mapInArrow(_exact(index.width), f"q long, ids {ids}, score double")
    each = scored.select("q", F.explode("ids").alias("id"), "score")
    each = each.groupBy("q", "id").agg(F.max("score").alias("score"))
    # One more than wanted, since the query's own id goes.
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    each = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    each = stage(each.drop("place"), "nearest")
    named = rows.join(asked, "vec").select(F.col("id").alias("query_id"), "q")
    pairs = named.join(each, "q").where(F.col("id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "id", "score")
