"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units, a run of spaces with the characters up to the next space: no piece of the model
reaches over such a cut. The distinct units of a batch are laid end to end and indexed by a suffix array
(sorted to the length of the longest piece); every piece is binary-searched for the range of suffixes
that begin with it. The ranges give edges from position to position; edges are sorted by their end and
relaxed position by position over all units at once.

The model is a BPE model, so a path is not scored by a sum: the encoding of a prefix ends in the one edge whose
piece stays beside the last piece of the prefix before it, that is, whose pair of pieces BPE itself would not
merge across. A pair is decided from the merge trees of its pieces: the pieces along the facing edges of
both trees, each in being from its own merge to the next, must not form a mergeable pair earlier than
either is used. This gives exactly the library's ids (tested against it on whole tables and random text).

Defined cases: null and empty texts have no ids; characters that the model lacks are written as the bytes
of their UTF-8; strings of control symbols in texts are ordinary text; repeated rows and very long texts
are encoded like others; extra columns stay, but for those that the results' names replace; an empty table gives an empty result. Decoding returns the text, with the
model's space sign (U+2581) as a space.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import table, texts
from hazeline.llm.common import pieces as runs_of_rows

MODEL = "piece_bpe_32k.model"
SIGN = "▁"
_NEVER = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """text: the pieces that BPE may use (others empty); byte_ids: ids of the 256 bytes; pair_keys, pair_ranks:
    left id * size + right id of every pair that is a piece, ascending, and the rank of the merge; right_edge and
    left_edge: for each piece the pieces along its right and left side, itself first; their merge ranks in
    right_rank and left_rank (-1 for a single character)."""

    text: list[str]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    right_edge: np.ndarray
    left_edge: np.ndarray
    rank: np.ndarray

    @property
    def size(self) -> int:
        return len(self.text)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """Reads a model file of the public tokenizers, or a path."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=name if os.sep in name else public_tokenizers.path(name))
    n = sp.get_piece_size()
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    text = [sp.id_to_piece(i) if ok else "" for i, ok in enumerate(plain)]
    by_text = {t: i for i, t in enumerate(text) if t}
    # Merges come by descending score; equal scores don't occur among merged pieces.
    order = sorted((i for i in by_text.values() if len(text[i]) > 1), key=lambda i: -sp.get_score(i))
    rank = np.full(n, -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    pairs = {}
    for i in order:
        for cut in range(1, len(text[i])):
            a, b = by_text.get(text[i][:cut]), by_text.get(text[i][cut:])
            if a is not None and b is not None:
                pairs[a * n + b] = int(rank[i])
    keys = np.array(sorted(pairs), np.int64)
    halves = {}
    for i in order:  # the merge that makes a piece is the last of its own encoding
        parts = [by_text[c] for c in text[i]]
        while len(parts) > 2:
            ranks = [pairs.get(a * n + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [order[ranks[at]]]
        halves[i] = tuple(parts)

    def edge(side: int) -> np.ndarray:
        rows = []
        for i in range(n):
            row = [i]
            while row[-1] in halves:
                row.append(halves[row[-1]][side])
            rows.append(row)
        out = np.full((n, max(map(len, rows)) + 1), -1, np.int32)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out

    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    return Vocabulary(text, byte_ids, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), edge(1), edge(0), rank)


def _sorted_rows(keys: np.ndarray) -> np.ndarray:
    """The order of rows of integers: by the first, then only among the rows that still tie by the next."""
    order = np.argsort(keys[:, 0], kind="stable")
    for k in range(1, keys.shape[1]):
        tied = np.zeros(len(order), bool)
        same = (keys[order[1:], :k] == keys[order[:-1], :k]).all(axis=1)
        tied[1:] |= same
        tied[:-1] |= same
        few = np.flatnonzero(tied)
        if not len(few):
            break
        group = np.cumsum(~np.r_[False, same])[few]
        order[few] = order[few][np.lexsort((keys[order[few], k], group))]
    return order


class Encoder:
    """Encodes batches of texts; decisions on pairs and the ids of units are remembered within bounds."""

    def __init__(self, v: Vocabulary, most_units: int = 400_000, most_characters: int = 200_000, log_pairs: int = 21):
        self.v, self.most_units, self.most_characters, self.units = v, most_units, most_characters, {}
        self.shift = np.uint64(64 - log_pairs)
        self.pair_at = np.full(1 << log_pairs, -1, np.int64)
        self.pair_ok = np.zeros(1 << log_pairs, bool)
        self.lengths = np.array([len(t) for t in v.text], np.int64)
        self.longest = int(self.lengths.max())
        # Characters of the model are numbered from 1; the last number stands for all others. A number is
        # spelt in two bytes, neither 0 nor 255, so that fixed-width bytes sort as the characters do.
        letters = sorted({c for t in v.text for c in t})
        self.code_of = np.full(0x110000, len(letters) + 1, np.int32)
        self.code_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        numbers = np.arange(len(letters) + 2)
        self.spelling = np.stack([numbers // 253 + 1, numbers % 253 + 1], axis=1).astype(np.uint8)
        width = 2 * self.longest
        spell = lambda t: self.spelling[self.code_of[[ord(c) for c in t]]].tobytes()
        spelt = {i: spell(v.text[i]) for i in np.flatnonzero(self.lengths).tolist()}
        self.usable = np.array(sorted(spelt, key=spelt.get), np.int64)
        self.low = np.array([spelt[i] for i in self.usable.tolist()], f"S{width}")
        self.high = np.array([spelt[i].ljust(width, b"\xff") for i in self.usable.tolist()], f"S{width}")
        alone = np.zeros(len(numbers), bool)
        alone[self.code_of[[ord(t) for t in v.text if len(t) == 1]]] = True
        self.alone = alone

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.v.size + b
        at = np.minimum(np.searchsorted(self.v.pair_keys, key), len(self.v.pair_keys) - 1)
        return np.where(self.v.pair_keys[at] == key, self.v.pair_ranks[at], _NEVER)

    def decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces a and b side by side."""
        ok = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        todo = np.arange(len(a))
        while len(todo):
            x, y = self.v.right_edge[a[todo], i[todo]], self.v.left_edge[b[todo], j[todo]]
            used_x = np.where(i[todo] > 0, self.v.rank[self.v.right_edge[a[todo], np.maximum(i[todo] - 1, 0)]], _NEVER)
            used_y = np.where(j[todo] > 0, self.v.rank[self.v.left_edge[b[todo], np.maximum(j[todo] - 1, 0)]], _NEVER)
            r = self.merge_rank(x, y)
            # On equal ranks the leftmost merge is first: the one that uses x on its left, before (x, y).
            crossed = (r < used_x) & (r <= used_y) & (r < _NEVER)
            ok[todo[crossed]] = False
            # Go back in time: undo the later of the two merges.
            born_x, born_y = self.v.rank[x], self.v.rank[y]
            back_x = born_x >= born_y
            i[todo] += back_x
            j[todo] += ~back_x
            todo = todo[~crossed & ((born_x >= 0) | (born_y >= 0))]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.v.size + b
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = self.pair_ok[at]
        new = np.flatnonzero(self.pair_at[at] != key)
        if len(new):
            unique, back = np.unique(key[new], return_inverse=True)
            known = self.decide(unique // self.v.size, unique % self.v.size)
            out[new] = known[back]
            self.pair_at[at[new]], self.pair_ok[at[new]] = key[new], known[back]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and piece of every occurrence of a piece in codes, by its suffix array.

        codes number the characters of the model from 1, 0 stands between units."""
        padded = np.r_[codes, np.zeros(self.longest, codes.dtype)]
        wide = self.spelling[padded].ravel()
        width = 2 * self.longest
        windows = np.lib.stride_tricks.sliding_window_view(wide, width)[0 : 2 * len(codes) : 2]
        starts = np.flatnonzero(codes)
        windows = np.ascontiguousarray(windows[starts])
        order = _sorted_rows(windows.view(">u8").reshape(len(starts), width // 8).astype(np.uint64))
        suffixes = windows[order].view(f"S{width}").ravel()
        lo, hi = np.searchsorted(suffixes, self.low), np.searchsorted(suffixes, self.high, side="right")
        count = hi - lo
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = starts[order[np.repeat(lo, count) + within]]
        return at, np.repeat(self.usable, count)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian 32-bit integers."""
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        code = self.code_of[points]
        first = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(len(code)) + np.repeat(np.arange(len(units)), sizes)
        codes = np.zeros(int((sizes + 1).sum()), np.int32)
        codes[place] = code
        at, piece = self.edges(codes)
        # Characters without a piece are edges of their own, -1 - code point, that stay beside anything.
        odd = np.flatnonzero(~self.alone[code])
        at, piece = np.r_[at, place[odd]], np.r_[piece, -1 - points[odd].astype(np.int64)]
        length = np.where(piece >= 0, self.lengths[np.maximum(piece, 0)], 1)
        unit = np.searchsorted(first, at, side="right") - 1
        end = at + length - first[unit]  # in characters of the unit
        order = np.argsort(end.astype(np.int32), kind="stable")
        at, piece, end = at[order], piece[order], end[order]
        length = length[order]
        none = -(1 << 40)
        last = np.full(len(codes) + 1, none, np.int64)  # by end position: the piece that ends there
        last[first] = none + 1  # nothing yet
        bounds = np.searchsorted(end, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            before, p = last[at[lo:hi]], piece[lo:hi]
            fits = before > none
            pair = np.flatnonzero(fits & (before >= 0) & (p >= 0))
            fits[pair] = self.compatible(before[pair], p[pair])
            good = np.flatnonzero(fits)
            last[at[lo:hi][good] + length[lo:hi][good]] = p[good]
        # Back from the ends of all units at once.
        where = first + sizes
        owner = np.arange(len(units))
        steps = []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            p = last[where[live]]
            steps.append((owner[live], p))
            where[live] -= np.where(p >= 0, self.lengths[np.maximum(p, 0)], 1)
            live = live[where[live] > first[live]]
        if not steps:
            return [b""] * len(units)
        owner = np.concatenate([s[0] for s in steps])[::-1]
        found = np.concatenate([s[1] for s in steps])[::-1]
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
        rare = np.flatnonzero(found < 0)
        if len(rare):
            spelt = [self.v.byte_ids[list(chr(-1 - p).encode("utf-8", "replace"))] for p in found[rare].tolist()]
            count = np.ones(len(found), np.int64)
            count[rare] = [len(x) for x in spelt]
            start = (np.cumsum(count) - count)[rare]
            owner, found = np.repeat(owner, count), np.repeat(found, count)
            for i, x in zip(start.tolist(), spelt, strict=True):
                found[i : i + len(x)] = x
        data = found.astype("<i4").tobytes()
        stops = 4 * np.searchsorted(owner, np.arange(len(units) + 1))
        return [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def encode(self, rows: list[str]) -> list[bytes]:
        split = [units_of(x) for x in rows]
        if len(self.units) > self.most_units:
            self.units = {}
        new = list({u for us in split for u in us}.difference(self.units))
        start = size = 0
        for i, u in enumerate(new, 1):  # edges take some hundred bytes a character
            size += len(u)
            if size >= self.most_characters or i == len(new):
                self.units.update(zip(new[start:i], self.encode_units(new[start:i]), strict=True))
                start, size = i, 0
        return [b"".join(map(self.units.__getitem__, us)) for us in split]


def units_of(text: str) -> list[str]:
    """The units of a text as the model sees it: a space first, spaces as their sign."""
    if not text:
        return []
    parts = text.replace(SIGN, " ").split(" ")
    units, held = [], SIGN
    if len(parts) == 1 or "" not in parts:
        return [SIGN + p for p in parts]
    for p in parts[:-1]:
        if p:
            units.append(held + p)
            held = SIGN
        else:
            held += SIGN
    return [*units, held + parts[-1]]


def decode(v: Vocabulary, rows: list[np.ndarray]) -> list[str]:
    """Texts of ids, by a table from id to bytes."""
    spelt = [t.replace(SIGN, " ").encode() for t in v.text]
    for b, i in enumerate(v.byte_ids.tolist()):
        spelt[i] = bytes([b])
    out = []
    for ids in rows:
        data = b"".join([spelt[i] for i in ids.tolist()])
        out.append((data[1:] if data[:1] == b" " else data).decode("utf-8", "replace"))
    return out


_encoders: dict[str, Encoder] = {}


def _encode(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary(name))  # lives as long as the worker
    for batch in batches:
        for part in runs_of_rows(batch, "text", 1 << 20):
            ids = _encoders[name].encode(texts(part, "text"))
            yield part.append_column("ids", pa.array(ids, pa.binary()))


def encoded(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """docs with ids, little-endian 32-bit integers end to end, as the last column; a column of that name is replaced."""
    rest = docs.drop(*[c for c in docs.columns if c.lower() == "ids"])
    return rest.mapInArrow(partial(_encode, name), rest.withColumn("ids", F.lit(b"")).schema)


def _decode(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(name)
    for batch in batches:
        rows = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("ids")]
        yield batch.append_column("decoded", pa.array(decode(v, rows), pa.string()))


def decoded(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """docs (..., ids) with decoded, the text of the ids, as the last column; a column of that name is replaced."""
    rest = docs.drop(*[c for c in docs.columns if c.lower() == "decoded"])
    return rest.mapInArrow(partial(_decode, name), rest.withColumn("decoded", F.lit("")).schema)


def _round_trips(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encodes and decodes in one worker, so that a task holds one set of tables."""
    for batch in _decode(name, _encode(name, batches)):
        ids = batch.column("ids")
        same = [x.replace(SIGN, " ") == y for x, y in zip(texts(batch, "text"), batch.column("decoded").to_pylist(), strict=True)]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array([len(x.as_buffer() or b"") // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64()),
                pa.array(same),
            ],
            names=["doc_id", "n_tokens", "ids_crc32", "round_trip"],
        )


def digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip: whether the
    decoded ids give the text again."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trips, name), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def _id_arrays(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _encode(name, batches):
        rows = batch.column("ids").to_pylist()
        n = np.array([len(x) // 4 for x in rows], np.int64)
        flat = pa.array(np.frombuffer(b"".join(rows), "<i4"))
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), flat)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("source"), pa.array(n), ids], names=["doc_id", "source", "n_tokens", "ids"]
        )


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their ids as an array."""
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long, ids array<int>"
    return docs.select("doc_id", "source", "text").mapInArrow(partial(_id_arrays, MODEL), schema)
