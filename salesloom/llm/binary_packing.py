"""Packed id matrices: best-fit-decreasing rows of a fixed number of tokens.

Documents are encoded, and one that is longer than a row is cut into whole rows and a
rest, so nothing is lost. Rests and shorter documents, longest first, go into the row
with the least room that still holds them. Rows are kept by their room in a segment
tree over all capacities, which finds the smallest sufficient one in a few steps.

A task packs lanes of about ``LANE_TOKENS`` tokens and writes three flat files beside
each other: the matrix of ids (unsigned 16 bit, ``PAD`` where a row is not full), the
cumulative segment lengths of each row (signed 32 bit, from 0 to the row's tokens),
and the position resets (signed 64 bit): the place in the matrix, counted over rows,
at which each segment starts and positions begin again at 0.

Defined results: a null, empty or blank text is its final id alone. Repeated rows are
packed as often as they occur, null ids stay null, an empty table gives an empty
result and no files. Other columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays, files, tokens
from salesloom.workspace import stage

WIDTH = 4096
LAST_ID = 49407
PAD = 0
LANE_TOKENS = 1 << 20


class RoomTree:
    """Rows by their room: a segment tree over capacities that counts rows below it."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the row with the least room that is at least ``size``: room, row."""
        node = size + self.size
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], width: int = WIDTH) -> list[tuple[int, int]]:
    """Row and place in it of each size. Sizes are taken as they come, longest first."""
    tree, rows, out = RoomTree(width), 0, []
    for size in sizes:
        found = tree.take(size)
        if found is None:
            found, rows = (width, rows), rows + 1
        room, row = found
        out.append((row, width - room))
        if room > size:
            tree.put(room - size, row)
    return out


def layout(bounds: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Pieces of documents with their rows: doc, start, length, row, offset, by row."""
    sizes = np.diff(bounds)
    parts = -(-sizes // width)
    doc = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = number * width
    length = np.minimum(sizes[doc] - start, width)
    order = np.argsort(-length, kind="stable")
    placed = np.array(best_fit(length[order].tolist(), width), dtype=np.int64).reshape(-1, 2)
    row, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    row[order], offset[order] = placed[:, 0], placed[:, 1]
    by_row = np.lexsort((offset, row))
    found = {"doc": doc, "start": start, "length": length, "row": row, "offset": offset}
    return {k: v[by_row] for k, v in found.items()}


def matrix(ids: np.ndarray, bounds: np.ndarray, found: dict[str, np.ndarray], width: int) -> np.ndarray:
    """The rows of a layout, padded."""
    out = np.full(((found["row"].max() + 1) * width), PAD, dtype="<u2")
    length = found["length"]
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    target = np.repeat(found["row"] * width + found["offset"], length) + within
    out[target] = ids[np.repeat(bounds[found["doc"]] + found["start"], length) + within]
    return out.reshape(-1, width)


def segment_ends(found: dict[str, np.ndarray]) -> np.ndarray:
    """Cumulative segment lengths of all rows: each row's 0, then its segments' ends."""
    first = found["offset"] == 0
    ends = (found["offset"] + found["length"]).astype("<i4")
    return np.insert(ends, np.flatnonzero(first), 0).astype("<i4")


_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "file", "row"]


def pack(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    tokenizer: str = tokens.WORD_TOKENIZER,
) -> DataFrame:
    """Write packed files below ``folder``; a row for each piece.

    Columns: doc_id, start and length in the document's ids, doc_tokens, sequence_id,
    offset in the sequence, ids_crc32 (of 32-bit little-endian ids), file (without
    ending) and row in it. The result is written before it is returned.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        out, done, lane, size = None, 0, [], 0
        for batch in batches:
            for part in arrays.sliced(batch, "text", tokens.SLICE_BYTES):
                ids, bounds, _ = encode(part.column("text"), LAST_ID)
                lane.append((part.column("doc_id"), ids, bounds))
                size += len(ids)
                if size >= LANE_TOKENS:
                    out = out or _Files(folder)
                    yield _packed(lane, width, out, done)
                    done, lane, size = out.rows, [], 0
        if lane:
            out = out or _Files(folder)
            yield _packed(lane, width, out, done)
        if out:
            out.close()

    numbers = ", ".join(f"{c} long" for c in _NAMES[1:7])
    return stage(
        rows.mapInArrow(work, f"doc_id {kind}, {numbers}, file string, row long"), "pieces"
    )


class _Files:
    def __init__(self, folder: str):
        self.ids = files.Writer(folder, "packed", "ids.u16")
        self.ends = files.Writer(folder, "packed", "ends.i32")
        self.resets = files.Writer(folder, "packed", "resets.i64")
        self.name = self.ids.name.removesuffix(".ids.u16")
        self.rows = 0

    def close(self) -> None:
        for part in (self.ids, self.ends, self.resets):
            part.close()


def _packed(lane: list[tuple], width: int, out: _Files, done: int) -> pa.RecordBatch:
    keys = pa.chunked_array([k for k, _, _ in lane])
    ids = np.concatenate([i for _, i, _ in lane])
    shifts = np.cumsum([0, *(len(i) for _, i, _ in lane)])
    bounds = np.concatenate([[0], *(b[1:] + s for (_, _, b), s in zip(lane, shifts, strict=False))])
    found = layout(bounds, width)
    packed = matrix(ids, bounds, found, width)
    row = found["row"] + done
    out.ids.write(packed)
    out.ends.write(segment_ends(found))
    out.resets.write((row * width + found["offset"]).astype("<i8"))
    out.rows = done + len(packed)
    begin = bounds[found["doc"]] + found["start"]
    whole = ids.astype("<u4")
    crc = [zlib.crc32(whole[a : a + n].data) for a, n in zip(begin.tolist(), found["length"].tolist(), strict=True)]
    first = TaskContext.get().partitionId() << 32
    columns = [
        keys.take(pa.array(found["doc"])).combine_chunks(),
        pa.array(found["start"]),
        pa.array(found["length"]),
        pa.array(np.diff(bounds)[found["doc"]]),
        pa.array(row + first),
        pa.array(found["offset"]),
        pa.array(crc, pa.int64()),
        pa.array([out.name] * len(row)),
        pa.array(row),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)
