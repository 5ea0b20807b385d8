"""Token ids of whole texts by the tokenizers library, by way of their distinct units."""

from __future__ import annotations

import json
import os
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of a .json file; name is a file of the public tokenizers or a path. Single-threaded,
    as Spark runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


assert sys.byteorder == "little", "ids are written as the machine holds them"


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_SPACE = _byte_set((9, 13), (32, 32))
_LETTER = _byte_set((65, 90), (97, 122))
_MARK = _byte_set((33, 47), (58, 64), (91, 96), (123, 126))
#: Bytes after which a character of white space beyond ASCII may end: those that follow C2, E1, E2 and E3.
_WIDE_LEAD = _byte_set((0xC2, 0xC2), (0xE1, 0xE3))
#: Leads of two-byte letters: U+00C0 to U+027F, but for the signs of multiplication and division.
_LETTER_LEAD = _byte_set((0xC3, 0xC9))


@lru_cache(maxsize=4)
def can_be_cut(name: str) -> bool:
    """Whether the tokenizer splits texts by the byte-level pattern alone: texts as they are, without a prefix."""
    spec = json.loads(tokenizer(name).to_str())
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    known = [t["content"] for t in spec["added_tokens"] if not t["normalized"] or t["special"]]
    return plain and spec["normalizer"] is None and len(known) == len(spec["added_tokens"])


def cuts(data: np.ndarray) -> np.ndarray:
    """For each position, the end included, whether the byte-level pattern always starts a pre-token there.

    It does at white space of ASCII after a character that isn't white space, and at a mark of ASCII after a
    letter of ASCII or of Latin-1 and its extensions: no pre-token holds such a pair, and the pattern looks
    ahead at white space alone.
    """
    out = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return out
    before, at = data[:-1], data[1:]
    # Characters of more than one byte: white space where their lead is one of white space, letters by their lead.
    wide, letter = np.zeros(len(data), bool), _LETTER[data]
    high = np.flatnonzero(data >= 128)
    after = high[np.isin(high - 1, high, assume_unique=True)] if len(high) else high
    lead = data[after - 1]
    wide[after] = _WIDE_LEAD[lead]
    letter[after] = _LETTER_LEAD[lead] & ~((lead == 0xC3) & ((data[after] == 0x97) | (data[after] == 0xB7)))
    third = after[after >= 2]
    wide[third] |= _WIDE_LEAD[data[third - 2]]
    out[1:-1] = (_SPACE[at] & ~_SPACE[before] & ~wide[:-1]) | (_MARK[at] & letter[:-1])
    return out


_SPACES = frozenset(np.flatnonzero(_SPACE).tolist())
#: Units that the library gets as one text.
JOINED = 256


class UnitEncoder:
    """Ids of whole texts as little-endian bytes by the tokenizers library.

    Texts are cut where the byte-level pattern always starts a new pre-token (see cuts). The distinct units
    of a batch are looked up, the library encodes those that weren't met before (the memory is bounded: when
    it is full, the units of the last batch stay), and the ids of all units are gathered by numpy. Texts that hold an added token,
    and all texts of tokenizers with another pattern, are encoded whole.
    """

    def __init__(self, name: str, most: int = 1_000_000):
        self.name, self.most, self.cut = name, most, can_be_cut(name)
        self.added = [t.content for t in tokenizer(name).get_added_tokens_decoder().values()]
        self.width = np.dtype("<u4") if tokenizer(name).get_vocab_size() > 1 << 16 else np.dtype("<u2")
        # Bytes of each id: the pattern's tokens hold a character a byte. Added tokens with white space could lie across joined units.
        vocabulary = tokenizer(name).get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.join = self.cut and not any(c.isspace() for t in self.added for c in t)
        self.known: dict[bytes, int] = {}  # a number by unit; its ids are flat[start[number] : start[number + 1]]
        self.flat, self.start = np.zeros(0, self.width), np.zeros(1, np.int64)

    def library(self, xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of xs end to end, and their number by text."""
        found = [e.ids for e in tokenizer(self.name).encode_batch_fast(xs, add_special_tokens=False)]
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.width, int(n.sum())), n

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that begin with white space and end with another character, and their number by unit.

        A pre-token starts at each of them in whatever follows the other, so the library gets them joined, and the ids are
        divided by their bytes."""
        ids, _ = self.library([b"".join(units[at : at + JOINED]).decode("utf-8") for at in range(0, len(units), JOINED)])
        ends, bounds = np.cumsum(self.size[ids]), np.cumsum([len(x) for x in units])
        last = np.searchsorted(ends, bounds)
        if not len(ends) or ends[-1] != bounds[-1] or (ends[last] != bounds).any():  # a vocabulary of another kind
            self.join = False
            return self.library([x.decode("utf-8") for x in units])
        return ids, np.diff(last, prepend=-1)

    def _learn(self, units: list[bytes], encode) -> None:
        for at in range(0, len(units), 20_000):
            few = units[at : at + 20_000]
            ids, n = encode(few)
            self.known.update(zip(few, range(len(self.known), len(self.known) + len(few)), strict=True))
            self.start = np.r_[self.start, self.start[-1] + np.cumsum(n)]
            self.flat = np.r_[self.flat, ids]

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The numbers of distinct units, new ones encoded first."""
        names = units.to_pylist()
        new = [x for x in names if x not in self.known]
        if self.join:
            self._learn([x for x in new if x[0] in _SPACES and x[-1] < 128 and x[-1] not in _SPACES], self._joined)
            new = [x for x in new if x not in self.known]
        self._learn(new, lambda few: self.library([x.decode("utf-8") for x in few]))
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if len(self.known) > self.most:
            self._keep(names, numbers)
            numbers = np.arange(len(names))
        return numbers

    def _keep(self, names: list[bytes], numbers: np.ndarray) -> None:
        """Forgets all units but these, which become numbers 0, 1, ..."""
        first, n = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        self.known = dict(zip(names, range(len(names)), strict=True))
        self.start = np.r_[0, np.cumsum(n)]
        self.flat = self.flat[np.arange(self.start[-1]) + np.repeat(first - self.start[:-1], n)]

    def encode(self, xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and their number by text."""
        whole = [i for i, x in enumerate(xs) if x and (not self.cut or any(t in x for t in self.added))]
        apart = set(whole)
        encoded = [b"" if i in apart else x.encode("utf-8") for i, x in enumerate(xs)]
        sizes = np.array([len(x) for x in encoded], np.int64)
        joined = b"".join(encoded)
        data = np.frombuffer(joined, np.uint8)
        stops = np.cumsum(sizes)
        # Every text starts a unit. The offsets make an array of units of the bytes as they lie.
        marked = cuts(data)
        marked[0] = marked[stops] = True
        bounds = np.flatnonzero(marked).astype(np.int32)
        ids, counts = np.zeros(0, self.width), np.zeros(len(xs), np.int64)
        if len(data):
            units = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
            coded = units.dictionary_encode()
            number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
            first, n = self.start[number], self.start[number + 1] - self.start[number]
            total = np.r_[0, np.cumsum(n)]
            ids = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
            at = total[np.searchsorted(bounds, np.r_[0, stops])]
            counts = np.diff(at)
        if whole:
            more, n = self.library([xs[i] for i in whole])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, part in zip(whole, np.split(more, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
            ids = np.concatenate(parts)
            counts[whole] = n
        return ids, counts


@lru_cache(maxsize=2)
def unit_encoder(name: str) -> UnitEncoder:
    """The encoder of a worker, which remembers units from task to task."""
    return UnitEncoder(name)
