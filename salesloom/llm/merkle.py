"""Merkle manifest of a table: a digest for every row and a proof up to one root.

Rows are ranked within their group, and the binary digits of the rank become columns.
Blocks hold ``2 ** DIGITS`` consecutive rows. Within a block the digits are grouped away
one after the other, the lowest first: each step collects at most two structs, puts their
digest beside them and nests them as children, so a block ends as one row with one nested
struct. All steps have the block in their key, so the rows are shuffled once for all of
them. A transform then walks from the block's top to its leaves, appends the sibling of
each node to the paths below it, and an explode emits the leaves with their proofs,
without a join.

The tops of the blocks are the leaves of the next layer, and so on until each group has
one node; the tops of the groups are then the leaves of one last tree. A layer has at most
``2 ** DIGITS`` rows in a group of Spark, whatever the size of the table. Paths of higher
layers reach the blocks below by one equality join of a row per block.

The rank comes from ranges that are counted alone, so a group that holds most rows is
not one task.

H is the lowercase hex SHA-256 of its inputs one after the other. A node without a
sibling is hashed alone, but a tree of one node is that node itself.

Defined results: nulls in any column are written ``-`` and differ from empty texts. Rows
with a null group form a group of their own, the first one. Repeated ids are ordered by
their digests; repeated rows have equal digests and a place each. An empty table gives no rows. Other
columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.ordered import RANGE, in_ranges
from salesloom.workspace import stage

# Binary digits of the rank within a block; a block is one row of 2 ** DIGITS leaves.
DIGITS = 8

STEP = "struct<left:boolean,digest:string>"  # a sibling, and whether it stands to the left


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """H of the values: ``-`` for null, else byte count, colon and value."""
    written = []
    for value in columns:
        value = value.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        written.append(F.coalesce(sized, F.lit("-")))
    return digest_of(F.concat(*written))


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number within the group from 0."""
    # A null group is told apart by a flag, since the joins below are on equal keys.
    name, missing = F.coalesce(F.col(group), F.lit("")), F.col(group).isNull()
    rows = rows.select(name.alias("g"), missing.alias("g_null"), *rows.columns)
    ranged = in_ranges(rows, ["g_null", "g"], [F.col(c) for c in order])
    keys = ["g", "g_null"]
    sizes = ranged.groupBy(*keys, RANGE).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # One row for each group and range.
    sizes = sizes.select(
        *keys, RANGE,
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"),
        F.sum("rows").over(whole).alias("total"),
    )
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    numbered = ranged.withColumn("inside", F.row_number().over(inside) - 1)
    placed = numbered.join(sizes, [*keys, RANGE])
    return placed.withColumn("place", F.col("inside") + F.col("earlier")).drop(RANGE, "inside", "earlier")


def _height(total: Column) -> Column:
    """Levels that a tree has within one block: enough for its leaves, or the whole block."""
    levels = F.lit(DIGITS)
    for k in reversed(range(DIGITS)):
        levels = F.when(total <= 2**k, F.lit(k)).otherwise(levels)
    return levels


def _steps(known: Column, left: Column, digest: Column) -> Column:
    """A path of one step, or of none where the level does not exist."""
    one = F.array(F.struct(left.alias("left"), digest.alias("digest")))
    return F.when(known, one).otherwise(F.array()).cast(f"array<{STEP}>")


def _leaves(node: Column, level: int) -> Column:
    """Leaves below a nested node of a level, with their paths from bottom to top."""
    if level == 0:
        return F.array(
            F.struct(
                node["payload"].alias("payload"),
                node["digest"].alias("digest"),
                F.array().cast(f"array<{STEP}>").alias("path"),
            )
        )
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        sibling = F.get(kids, 1 - i)["digest"]
        step = _steps(F.col("height") >= level, i == 1, sibling)
        return F.transform(
            _leaves(kid, level - 1),
            lambda leaf: F.struct(
                leaf["payload"].alias("payload"),
                leaf["digest"].alias("digest"),
                F.concat(leaf["path"], step).alias("path"),
            ),
        )

    return F.flatten(F.transform(kids, below))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block: g, g_null, block, total, top and its leaves (payload, digest, path).

    ``nodes`` has g, g_null, place, total, digest and payload.
    """
    keys = ["g", "g_null", "block", "total"]
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "g",
        "g_null",
        F.shiftright("place", DIGITS).alias("block"),
        "total",
        *[(F.shiftright("place", k) % 2).cast("int").alias(d) for k, d in enumerate(digits)],
        F.struct("digest", "payload").alias("node"),
    ).repartition("g", "g_null", "block")
    for k, digit in enumerate(digits):
        pair = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node")))
        rows = rows.groupBy(*keys, *digits[k + 1 :]).agg(F.transform(pair, lambda x: x["node"]).alias("kids"))
        both = F.array_join(F.transform("kids", lambda x: x["digest"]), "")
        # Above the top of a small tree there is one node, which stays as it is.
        own = F.when(_height(F.col("total")) > k, digest_of(both)).otherwise(F.col("kids")[0]["digest"])
        rows = rows.withColumn("node", F.struct(own.alias("digest"), "kids")).drop("kids")
    rows = rows.withColumn("height", _height(F.col("total")))
    top = F.col("node")["digest"].alias("top")
    return rows.select(*keys, top, _leaves(F.col("node"), DIGITS).alias("leaves"))


def _tree(nodes: DataFrame) -> DataFrame:
    """The trees of all groups: one row per block with g, g_null, leaves, above and top.

    ``above`` is the path from the block's top to the top of the group.
    """
    blocks = stage(_blocks(nodes), "blocks")
    open_groups = blocks.where(F.col("total") > 2**DIGITS)
    none = F.array().cast(f"array<{STEP}>")
    if open_groups.isEmpty():
        return blocks.select("g", "g_null", "leaves", none.alias("above"), "top")
    higher = _tree(
        open_groups.select(
            "g",
            "g_null",
            F.col("block").alias("place"),
            F.ceil(F.col("total") / 2**DIGITS).alias("total"),
            F.col("top").alias("digest"),
            F.struct("block").alias("payload"),
        )
    )
    higher = higher.select("g", "g_null", "top", "above", F.explode("leaves").alias("leaf")).select(
        "g",
        "g_null",
        F.col("leaf.payload.block").alias("block"),
        F.concat("leaf.path", "above").alias("above"),
        F.col("top").alias("group_top"),
    )
    return blocks.join(higher, ["g", "g_null", "block"], "left").select(
        "g",
        "g_null",
        "leaves",
        F.coalesce("above", none).alias("above"),
        F.coalesce("group_top", "top").alias("top"),
    )


def manifest(rows: DataFrame, key: str, group: str, digest: Column, payload: Column) -> DataFrame:
    """payload, leaf, subroot, root and path of every row of ``rows``.

    Leaves are ``digest``, in the order of ``key`` within ``group``. ``path`` lists the
    siblings from the leaf to the root; a level without a sibling has a null digest.
    """
    leaves = rows.select(
        F.col(key).alias("k"),
        F.col(group).cast("string").alias("part"),
        digest.alias("digest"),
        payload.alias("payload"),
    )
    placed = _placed(leaves, "part", ["k", "digest"])
    blocks = stage(_tree(placed.select("g", "g_null", "place", "total", "digest", "payload")), "tree")
    tops = blocks.select("g", "g_null", "top").distinct()
    tops = tops.select(
        F.lit("").alias("all"),
        (~F.col("g_null")).alias("named"),
        F.col("g").alias("name"),
        F.col("top").alias("digest"),
        F.struct("g", "g_null").alias("payload"),
    )
    placed = _placed(tops, "all", ["named", "name"])
    crown = _tree(placed.select("g", "g_null", "place", "total", "digest", "payload"))
    crown = crown.select(
        F.explode("leaves").alias("leaf"), F.col("above").alias("crown"), F.col("top").alias("root")
    ).select("leaf.payload.*", F.concat("leaf.path", "crown").alias("crown"), "root")
    found = blocks.join(crown, ["g", "g_null"]).select(
        F.explode("leaves").alias("leaf"),
        F.concat("above", "crown").alias("rest"),
        F.col("top").alias("subroot"),
        "root",
    )
    return found.select(
        "leaf.payload",
        F.col("leaf.digest").alias("leaf"),
        "subroot",
        "root",
        F.concat("leaf.path", "rest").alias("path"),
    )


def proof_digest(path: Column) -> Column:
    """H of the siblings of a path."""
    return digest_of(F.array_join(F.transform(path, lambda s: s["digest"]), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(held: Column, s: Column) -> Column:
        sibling = F.coalesce(s["digest"], F.lit(""))
        return digest_of(
            F.when(s["left"], F.concat(sibling, held)).otherwise(F.concat(held, sibling))
        )

    return F.aggregate(path, leaf, step)


TAMPER_EVERY = 7


def document_manifest(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """Manifest of the documents, and a check of a copy in which some rows were changed.

    In the copy, rows whose hash of the id ``tamper_every`` divides have one character
    more in ``n_chars``. Their proofs must lead to another root.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    own = [F.col(c) for c in columns]
    more = F.try_add(F.col("n_chars"), F.lit(1))
    changed = [more if c == "n_chars" else F.col(c) for c in columns]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    other = F.when(chosen & more.isNotNull(), leaf_digest(changed))
    payload = F.struct("doc_id", other.alias("changed"))
    found = manifest(docs, "doc_id", "lang", leaf_digest(own), payload)
    found = found.select(
        "payload.doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("payload.changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
