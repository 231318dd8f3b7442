"""Token files: separators across blocks, packed matrices, exact round trips."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salesloom.llm import binary_packing, files, token_counts, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_TOKENIZER))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_counts(request, tmp_path, which):
    docs = request.getfixturevalue(which)
    rows = token_counts.counted(docs, str(tmp_path / "t")).collect()
    want = sorted((str(d.doc_id), len(ids_of(d.text))) for d in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_stitching(spark, tmp_path, block):
    sep = token_counts.SEPARATOR
    rng = np.random.default_rng(block)
    contents = {
        "a.u16": rng.choice([1, 2, 3, sep], 500, p=[0.4, 0.3, 0.25, 0.05]),
        "b.u16": np.array([sep]),
        "c.u16": np.array([5] * 300),
        "d.u16": np.array([sep, sep, 7, sep]),
        "e.u16": np.array([], dtype=int),
        "f.u16": np.array([9, sep, 9, 9]),
    }
    for name, ids in contents.items():
        raw = ids.astype("<u2").tobytes() + (b"x" if name == "f.u16" else b"")
        (tmp_path / name).write_bytes(raw)
    want = []
    for name, ids in contents.items():
        at, ends = 0, np.flatnonzero(ids == sep).tolist()
        for i, end in enumerate(ends):
            want.append((name, i, at, end - at, True))
            at = end + 1
        if at < len(ids):
            want.append((name, len(ends), at, len(ids) - at, False))
    got = token_counts.document_spans(spark, str(tmp_path), block_bytes=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_documents(documents, tmp_path):
    assert token_counts.counted(documents.limit(0), str(tmp_path / "none")).count() == 0
    assert binary_packing.pack(documents.limit(0), str(tmp_path / "none2")).count() == 0


def plain_best_fit(sizes, width):
    room, out = [], []
    for size in sizes:
        fits = [r for r in room if r >= size]
        if fits:
            room[room.index(min(fits))] -= size
            out.append(min(fits))
        else:
            room.append(width - size)
            out.append(width)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), min_size=1, max_size=80))
def test_rows_with_the_least_room(sizes):
    sizes = sorted(sizes, reverse=True)
    placed = binary_packing.best_fit(sizes, 37)
    assert [37 - offset for _, offset in placed] == plain_best_fit(sizes, 37)
    used = defaultdict(int)
    for (row, offset), size in zip(placed, sizes, strict=True):
        assert used[row] == offset
        used[row] += size
    assert max(used.values()) <= 37


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_packed_files(request, tmp_path, monkeypatch, which):
    monkeypatch.setattr(binary_packing, "LANE_TOKENS", 30_000)
    docs = request.getfixturevalue(which)
    folder, width = str(tmp_path / "p"), 256
    rows = binary_packing.pack(docs, folder, width=width).collect()
    data = {}
    for name in {r.file for r in rows}:
        parts = []
        for ending, kind in (("ids.u16", "<u2"), ("ends.i32", "<i4"), ("resets.i64", "<i8")):
            store, path = files.opened(f"{folder}/{name}.{ending}")
            parts.append(np.frombuffer(files.read(path, 0, store.get_file_info(path).size), kind))
        data[name] = parts
    by_doc, by_row, resets = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = data[r.file][0].reshape(-1, width)[r.row, r.offset : r.offset + r.length]
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, ids.tolist()))
        by_row[(r.file, r.row)].append((r.offset, r.length))
        resets[r.file].append(r.row * width + r.offset)
    want = defaultdict(list)
    for d in docs.collect():
        ids = [*ids_of(d.text), binary_packing.LAST_ID]
        want[(d.doc_id, len(ids))].append(ids)
    assert set(want) == set(by_doc)
    for key, texts in want.items():
        joined = [i for _, part in sorted(by_doc[key]) for i in part]
        assert joined == texts[0] if len(texts) == 1 else sorted(joined) == sorted(sum(texts, []))
    for name, (ids, ends, starts) in data.items():
        lines = [sorted(by_row[k]) for k in sorted(by_row) if k[0] == name]
        assert len(ids) == len(lines) * width
        assert ends.tolist() == [x for line in lines for x in (0, *(o + n for o, n in line))]
        assert starts.tolist() == sorted(resets[name])
        for k, line in enumerate(lines):
            assert all(a + n == b for (a, n), (b, _) in zip(line, line[1:], strict=False))
            used = sum(n for _, n in line)
            assert (ids.reshape(-1, width)[k, used:] == binary_packing.PAD).all()
