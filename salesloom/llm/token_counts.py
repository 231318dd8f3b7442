"""Token counts of the documents in flat token files, by a search for separators.

A token file is a plain row of unsigned 16-bit little-endian ids; the id ``SEPARATOR``
ends every document, and nothing else tells where one begins. ``document_spans`` cuts
the files into blocks of ``BLOCK_BYTES``, and each task finds the separators of its
blocks with one vector comparison. Blocks are stitched by a prefix scan over one row
per block: the last separator and the number of separators before it. A document
that starts in one block and ends in a later one thereby has its true start.

``write_tokens`` makes such files from texts: one for each partition, each document's
ids and a separator. It returns the order of the documents in each file.

Defined results: a null, empty or blank text has no tokens. Ids after the last
separator of a file are a document that is not complete; a file that ends with one
has none. Empty files have no documents. An odd last byte is not an id and is left
out. Repeated rows are written as often as they occur, null ids stay null, an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import arrays, files, tokens
from salesloom.workspace import stage

# The end-of-text id of the tokenizer; no text gives it.
SEPARATOR = 49407
BLOCK_BYTES = 8 << 20
BYTES_PER_TASK = 64 << 20


def write_tokens(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = tokens.WORD_TOKENIZER,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Write token files below ``folder``; rows: file, ordinal, doc_id.

    The result is written before it is returned, so the files are complete.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        out, done = None, 0
        for batch in batches:
            for part in arrays.sliced(batch, "text", tokens.SLICE_BYTES):
                out = out or files.Writer(folder, "tokens", "u16")
                out.write(encode(part.column("text"), separator)[0].astype("<u2"))
                n = part.num_rows
                columns = [pa.array([out.name] * n), pa.array(np.arange(done, done + n))]
                yield pa.RecordBatch.from_arrays([*columns, part.column("doc_id")], names=names)
                done += n
        if out:
            out.close()

    names = ["file", "ordinal", "doc_id"]
    return stage(rows.mapInArrow(work, f"file string, ordinal long, doc_id {kind}"), "order")


def _separators(separator: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = files.read(path, offset, size - size % 2)
                places = np.flatnonzero(np.frombuffer(raw, "<u2") == separator) + offset // 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        pa.array([offset], pa.int64()),
                        pa.array([(offset + len(raw)) // 2], pa.int64()),
                        pa.array([places], pa.list_(pa.int64())),
                    ],
                    names=["path", "offset", "until", "places"],
                )

    return work


def document_spans(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.u16",
    separator: int = SEPARATOR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents of all token files: file, ordinal, start, n_tokens, complete."""
    found = files.listed(spark, folder, pattern).where("length > 1")
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    offsets = F.sequence(F.lit(0).cast("long"), F.col("length") - 2, F.lit(block_bytes))
    blocks = found.select("path", "length", F.explode(offsets).alias("offset"))
    blocks = blocks.select(
        "path", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("size")
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    searched = blocks.repartition(tasks, "path", "offset").mapInArrow(
        _separators(separator), "path string, offset long, until long, places array<long>"
    )
    searched = stage(searched, "separators")
    edges = searched.select(
        "path", "offset", F.get("places", F.size("places") - 1).alias("last"), F.size("places").alias("n")
    )
    earlier = "over (partition by path order by offset rows between unbounded preceding and 1 preceding)"
    edges = edges.select(
        "path",
        "offset",
        F.expr(f"coalesce(max(last) {earlier}, -1)").alias("before"),
        F.expr(f"coalesce(sum(n) {earlier}, 0)").alias("done"),
        F.expr("lead(offset) over (partition by path order by offset) is null").alias("final"),
    )
    stitched = searched.join(edges, ["path", "offset"])
    ended = stitched.select("path", "before", "done", "places", F.posexplode("places").alias("i", "end"))
    ended = ended.select(
        "path",
        (F.col("done") + F.col("i")).alias("ordinal"),
        (F.coalesce(F.get("places", F.col("i") - 1), "before") + 1).alias("start"),
        "end",
        F.lit(True).alias("complete"),
    )
    last = F.coalesce(F.get("places", F.size("places") - 1), F.col("before"))
    open_end = stitched.where(F.col("final") & (last + 1 < F.col("until"))).select(
        "path",
        (F.col("done") + F.size("places")).alias("ordinal"),
        (last + 1).alias("start"),
        F.col("until").alias("end"),
        F.lit(False).alias("complete"),
    )
    return ended.unionByName(open_end).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("ordinal").cast("long").alias("ordinal"),
        "start",
        (F.col("end") - F.col("start")).alias("n_tokens"),
        "complete",
    )


def counted(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Token count of each document by way of its files: doc_id, file, ordinal, start, n_tokens."""
    order = write_tokens(docs, folder, **options)
    spans = document_spans(docs.sparkSession, folder) if not order.isEmpty() else None
    if spans is None:
        return order.selectExpr("doc_id", "file", "ordinal", "0L as start", "0L as n_tokens")
    return order.join(spans, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
