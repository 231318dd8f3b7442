"""Near-duplicate groups: circulant MinHash, banding, exact check of every link.

Two fixed permutations serve a whole signature. The first scatters the shingles
over a ring; the second, shifted by k places, gives coordinate k. Documents that
agree in a band are candidates, and a link counts only after a comparison of the
full shingle sets. With 16 bands of 4 coordinates a pair at the threshold of 0.85
is missed with a chance below 1e-5, a closer pair with less.

A bucket's members are never paired with each other all at once. Each round makes
some of them leads, outside the bucket's largest component, and compares these with
the members that are not yet in the lead's component. First come two cheap tests: set
sizes that cannot reach the threshold, and a sketch of one bit of each of 2048 further
coordinates, in which a pair at the threshold differs in more than the allowed places
with a chance below 1e-5. Full sets decide on what is left, and confirmed links merge
components. A bucket is done when its remaining members are in one component, so no
link between components is skipped and a group of copies costs a few comparisons for
each member. The number of leads grows from round to round.

Defined results: a null or blank text has no shingles and is a group of its own
(``component_id`` is its own id). Documents with equal shingle sets are one node,
so copies cost one row each. Repeated rows and repeated ids stay one row each.
Ids that are null take part, and a component of null ids only has a null id. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays
from salesloom.workspace import stage

RING = 1 << 20
SEED = 20240607
BANDS, ROWS = 16, 4
# Leads of a bucket in the first round, on average, and their growth by round.
LEADS, GROWTH = 4, 16
# Coordinates in the sketch (a multiple of 64), and how many standard deviations more
# than expected at the threshold may differ.
SKETCH, DEVIATIONS = 2048, 4.75
# Pairs of nodes that a task reads in a round of the components.
PAIRS_PER_TASK = 100_000

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and for each place of the ring the ``coordinates``
    values that the shifted second permutation gives there."""
    if coordinates not in _tables:
        rng = np.random.default_rng(SEED)
        scatter = rng.permutation(RING).astype(np.uint32)
        ring = rng.permutation(RING).astype(np.uint32)
        wrapped = np.concatenate([ring, ring[:coordinates]])
        _tables[coordinates] = (
            scatter,
            np.lib.stride_tricks.sliding_window_view(wrapped, coordinates),
        )
    return _tables[coordinates]


def signature(shingle_set: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit shingle hashes."""
    scatter, shifted = permutations(coordinates)
    low = np.full(coordinates, RING, dtype=np.uint32)
    for a in range(0, len(shingle_set), 1024):
        places = scatter[(shingle_set[a : a + 1024] >> np.uint64(44)).astype(np.int64)]
        np.minimum(low, shifted[places].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    rows = low.reshape(bands, -1).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows.shape[1]):
        total = arrays.mix(total ^ rows[:, k]) + np.uint64(k)
    return arrays.mix(total).view(np.int64)


def sketch(shingle_set: np.ndarray, coordinates: int = SKETCH) -> np.ndarray:
    """The lowest bit of each coordinate of a long signature, packed in 64-bit numbers."""
    bits = (signature(shingle_set, coordinates) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_different(percent: int, coordinates: int = SKETCH) -> int:
    """Differing bits that two sketches at the threshold may have."""
    chance = (1 - percent / 100) / 2
    return int(coordinates * chance + DEVIATIONS * math.sqrt(coordinates * chance * (1 - chance)))


def set_key(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in arrays.sliced(batch, "text"):
        flat, starts = arrays.words(part.column("text"), lower=True)
        runs, begins = arrays.shingles(arrays.word_hashes(flat), starts, size)
        yield part, [np.unique(runs[a:b]) for a, b in zip(begins, begins[1:], strict=False)]


def _signatures(size: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                keys = [
                    band_keys(signature(s, bands * rows), bands) if len(s) else None for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
                )

    return work


def _set_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                short = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "n_shingles", "bands")), short, listed],
                    names=["node", "n_shingles", "bands", "sketch", "shingles"],
                )

    return work


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _inlined(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each row and each of the named pairs of columns."""
    return rows.select(
        F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends]))
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (x, y): columns node, label.

    Alternates two steps until nothing changes, each one sum by key and one join:
    larger neighbours move to the smallest neighbour, then smaller ones do. The
    result is a star for each component, in a number of rounds that grows with the
    logarithm of its size. A round reads its pairs in as many tasks as their number
    asks for; the pairs of one task need no exchange.
    """
    pairs = stage(
        edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .where("u <> v")
        .distinct(),
        label,
    )
    seen = _print(pairs)
    while True:
        near = pairs.coalesce(seen[0] // PAIRS_PER_TASK + 1)
        both = _inlined(near, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _inlined(large.join(low, "u"), ("v", "m"), ("u", "m"))
        pairs = stage(small.where("u <> v").distinct(), label)
        now = _print(pairs)
        if now == seen:
            break
        seen = now
    stars = pairs.groupBy("u").agg(F.min("v").alias("label"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), "label").unionByName(roots)


def _decided(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    size: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Rows of ``near_duplicates`` with the hash of the text and the component's node."""
    source = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    signed = stage(
        source.mapInArrow(
            _signatures(size, bands, rows),
            "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>",
        ),
        "signatures",
    )
    nodes = stage(
        signed.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("low_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("one"),
            F.min("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    entries = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(entries.join(shared.select("bucket"), "bucket"), "members")
    labels = stage(members.select("node", F.col("node").alias("label")).distinct(), "labels")
    wanted = nodes.join(labels.select("node"), "node").select(
        "node",
        "n_shingles",
        "bands",
        F.col("one.doc_id").alias("one_id"),
        F.col("one.text_hash").alias("one_hash"),
    )
    found = source.join(
        wanted,
        (source.text_hash == wanted.one_hash) & source.doc_id.eqNullSafe(wanted.one_id),
    ).select("node", "n_shingles", "bands", "text")
    kind = "node long, n_shingles long, bands array<long>, sketch array<long>, shingles array<long>"
    sets = stage(found.mapInArrow(_set_rows(size), kind).dropDuplicates(["node"]), "sets")
    leads = LEADS
    while True:
        opened = stage(_opened(members, labels, sets, leads), "open")
        if opened.isEmpty():
            break
        pairs = stage(_pairs(opened, percent, bands), "pairs")
        members = opened.where("not lead").select("band", "bucket", "node")
        leads *= GROWTH
        links = stage(_links(pairs, sets, percent), "links")
        if not links.isEmpty():
            labels = stage(_merged(labels, links), "labels")
    groups = nodes.select("set_key", "node", "low_id").join(labels, "node", "left")
    groups = groups.withColumn("label", F.coalesce("label", "node"))
    lowest = groups.groupBy("label").agg(F.min("low_id").alias("component_id"))
    by_set = groups.join(lowest, "label").select("set_key", "label", "component_id")
    own = F.col("set_key").isNull()
    return signed.join(by_set, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (own | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "text_hash",
        "label",
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, **options
) -> DataFrame:
    """Component of each document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of five-word shingles (``size``; ``bands`` and ``rows`` shape the
    signature).
    """
    return _decided(docs, key, text, percent, **options).drop("text_hash", "label")


def _opened(members: DataFrame, labels: DataFrame, sets: DataFrame, leads: int) -> DataFrame:
    """Members of the buckets with more than one component, and which of them lead.

    About ``leads`` members of each bucket lead, or all that are outside its largest
    component; the choice is a hash of member and round.
    """
    named = members.join(labels, "node")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("n", "label")).alias("largest"), F.sum("n").alias("all"))
        .where(F.col("all") > F.col("largest.n"))
        .select(
            "bucket",
            F.col("largest.label").alias("main"),
            F.ceil((F.col("all") - F.col("largest.n")) / leads).alias("share"),
        )
    )
    chosen = F.pmod(F.xxhash64("node", F.lit(leads)), F.col("share")) == 0
    lead = (F.col("label") != F.col("main")) & chosen
    named = named.join(buckets, "bucket")
    named = named.select("band", "bucket", "node", "label", lead.alias("lead"))
    return named.join(sets.select("node", "n_shingles", "bands", "sketch"), "node")


def _pairs(opened: DataFrame, percent: int, bands: int) -> DataFrame:
    """Pairs of a lead and a member of another component that may be similar enough.

    A pair counts in the first band that its two nodes share. Each bucket by itself
    compares all pairs of its components, so the others need not. Two leads meet twice
    and count once. Sketches, the dearest test, are compared last.
    """
    columns = ("node", "label", "n_shingles", "bands", "sketch")
    side = opened.where("lead").select("bucket", *[F.col(c).alias(f"y_{c}") for c in columns])
    smaller = F.least("n_shingles", "y_n_shingles")
    larger = F.greatest("n_shingles", "y_n_shingles")
    # Functions of whole arrays: a long expression of their places is too large a method
    # for the JVM to compile.
    bits = F.zip_with("sketch", "y_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    different = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    sized = smaller * 100 >= larger * percent
    near = different <= most_different(percent)
    same = F.zip_with("bands", "y_bands", lambda a, b: a == b)
    once = F.array_position(same, F.lit(True)) == F.col("band") + 1
    met_once = ~F.col("lead") | (F.col("node") < F.col("y_node"))
    apart = F.col("label") != F.col("y_label")
    kept = opened.join(side, "bucket").where(apart & met_once & sized & once & near)
    return kept.select(
        F.least("node", "y_node").alias("x"), F.greatest("node", "y_node").alias("y")
    )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    compared = pairs.join(
        sets.select(F.col("node").alias("x"), F.col("shingles").alias("xs")), "x"
    ).join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("ys")), "y")
    both = F.size(F.array_intersect("xs", "ys"))
    union = F.size("xs") + F.size("ys") - both
    return compared.where(both * 100 >= union * percent).select("x", "y")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that the links connect."""
    side = labels.withColumnRenamed("node", "x").withColumnRenamed("label", "x_label")
    other = labels.withColumnRenamed("node", "y").withColumnRenamed("label", "y_label")
    edges = links.join(side, "x").join(other, "y")
    found = components(edges.select(F.col("x_label").alias("x"), F.col("y_label").alias("y")))
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each component: the one with the smallest id.

    Where that id has several rows in the component, one of them stays. Documents
    without shingles are linked with nothing and all stay. All columns are kept.
    """
    kept = _decided(docs, key, text, **options).where("kept")
    blank = F.col("n_shingles") == 0
    counted = kept.groupBy("label", "doc_id", "text_hash", blank.alias("blank")).agg(
        F.count("*").alias("copies")
    )
    chosen = counted.where("not blank").groupBy("label", "doc_id")
    chosen = chosen.agg(F.min(F.struct("text_hash", "copies")).alias("one"))
    chosen = chosen.select("doc_id", "one.text_hash", "one.copies").unionByName(
        counted.where("blank").select("doc_id", "text_hash", F.lit(1).cast("long").alias("copies"))
    )
    kept_id, kept_hash, copies, own = (
        arrays.fresh(c, docs) for c in ("_kept_id", "_kept_hash", "_copies", "_text_hash")
    )
    chosen = stage(chosen, "kept").toDF(kept_id, kept_hash, copies)
    rows = docs.withColumn(own, F.xxhash64(text)).join(
        chosen,
        (F.col(own) == F.col(kept_hash)) & F.col(key).eqNullSafe(F.col(kept_id)),
    )
    once = rows.where(F.col(copies) == 1).select(docs.columns)
    again = rows.where(F.col(copies) > 1).dropDuplicates([key, own]).select(docs.columns)
    return once.unionByName(again)
