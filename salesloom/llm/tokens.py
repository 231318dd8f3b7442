"""Token ids of many texts at once with a public tokenizer that drops white space.

Such a tokenizer never joins characters across a blank, so a text's ids are those of
its words one after the other, and it lower-cases, so A to Z may be lowered before.
Each distinct word is put together once from its body and closing signs, which are
encoded once, and remembered; beyond its number of entries a memory is emptied. Many
words are encoded as one text in which a special token stands between them.
Strings of special tokens in a text are ordinary text, so special ids never come out
of a text.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from salesloom.llm import arrays

# A task has one core; threads of its own would only get in the way of other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_TOKENIZER = "word_bpe_49k.json"
REMEMBERED, REMEMBERED_WORDS = 1_000_000, 500_000
# Text bytes encoded at a time: each distinct word of a slice is handled once.
SLICE_BYTES = 8 << 20
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_encoders: dict[str, WordEncoder] = arrays.memory()


class _Pool:
    """Names with a stretch of ids each."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(names, range(at, at + len(names)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def places(self, names: list[str]) -> np.ndarray:
        """Places of the names, -1 for unknown ones."""
        found = map(self.known.get, names, repeat(-1))
        return np.fromiter(found, dtype=np.int64, count=len(names))

    def taken(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places one after the other, and where each place's ids end."""
        size = self.size[places]
        ends = np.cumsum(size)
        source = np.repeat(self.begin[places] - ends + size, size)
        source += np.arange(len(source))
        return self.ids[source], ends


class WordEncoder:
    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.cutting = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = {t.content: i for i, t in self.cutting.get_added_tokens_decoder().items()}
        self._forget()

    def _forget(self) -> None:
        """The memory: whole words, whether they close a sentence, and their pieces."""
        self._forget_words()
        self.pieces = _Pool()
        self.pieces.add([""], np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))

    def _forget_words(self) -> None:
        self.words = _Pool()
        self.closes = np.zeros(0, dtype=bool)

    def _learn(self, words: list[str]) -> None:
        """Add words. After a letter or digit, a run of other signs is encoded by itself."""
        bare = [w.rstrip(SIGNS) for w in words]
        bodies = [b if b and b[-1].isalnum() else w for b, w in zip(bare, words, strict=True)]
        signs = [w[len(b) :] for b, w in zip(bodies, words, strict=True)]
        new = list(dict.fromkeys(x for x in chain(bodies, signs) if x not in self.pieces.known))
        for a in range(0, len(new), 1000):
            part = new[a : a + 1000]
            self.pieces.add(part, *self._encoded(part))
        both = np.stack([self.pieces.places(bodies), self.pieces.places(signs)], axis=1)
        ids, ends = self.pieces.taken(both.ravel())
        self.words.add(words, ids, np.diff(ends[1::2], prepend=0))
        closes = np.fromiter((w[-1] in ".!?" for w in words), dtype=bool, count=len(words))
        self.closes = np.concatenate([self.closes, closes])

    def _encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the names one after the other, and how many each has."""
        cut = next(iter(self.special), None)
        text = "" if cut is None else cut.join(names)
        if cut is not None and all(text.count(s) == (len(names) - 1) * (s == cut) for s in self.special):
            whole = self.cutting.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(whole[0].ids, dtype=np.uint32)
            own = ids != self.special[cut]
            ends = np.concatenate([np.flatnonzero(~own), [len(ids)]])
            if len(ends) == len(names):
                return ids[own], np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=size.sum()), size

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of the distinct words in the memory, after learning the new ones."""
        if len(self.pieces.known) > REMEMBERED:
            self._forget()
        elif len(self.words.known) > REMEMBERED_WORDS:
            self._forget_words()
        at = self.words.places(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words.known) + np.arange(len(new))
            self._learn([words[i] for i in new.tolist()])
        return at

    def encode(
        self, texts: pa.Array, last: int | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each text's start (n + 1 numbers), and the places among the
        ids where a sentence ends.

        ``last`` is put after the ids of every text; a null text has no others.
        """
        flat, starts = arrays.words(texts, lower=True)
        coded = flat.dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        if last is not None:
            name = f" {last}"  # no word holds a blank
            if name not in self.words.known:
                self.words.add([name], np.array([last], dtype=np.uint32), np.ones(1, dtype=np.int64))
                self.closes = np.append(self.closes, False)
            at = np.insert(at, starts[1:], self.words.known[name])
            starts = starts + np.arange(len(starts))
        ids, ends = self.words.taken(at)
        return ids, np.concatenate([[0], ends])[starts], ends[self.closes[at]]


def encoder(name: str = WORD_TOKENIZER) -> WordEncoder:
    """The encoder of this process; every task of a worker shares it."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]
