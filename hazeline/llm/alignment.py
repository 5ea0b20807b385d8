"""Alignment of two tokenizers' tokens of the same texts, by divide and conquer at shared cuts.

A byte-level tokenizer (A) and a SentencePiece model (B) cut a text's bytes, its leading space included, into tokens. An
interval of both is divided where a token of A and a token of B end at the same byte: the ends of A are tried from
the middle outwards, each bisected into those of B; both halves are divided again, and an interval without a
shared cut is a group. All intervals of a batch are divided together, a numpy step for each try.

Inside a group no cut is shared, so its links (pairs of tokens whose bytes overlap) are one more than its inner cuts. Links of
id pairs are counted over the corpus. The pairs with the highest counts, HEAD of them at most, are looked up where the documents
are; all other pairs are joined, so that no key of the join stands in many documents, and the result is exact.

Tokens come from the libraries by way of distinct units: a text is cut at spaces where both tokenizers always cut, and a
worker encodes each unit once while it remembers it. Models whose pieces reach over a space are given whole texts.

Defined cases: null and empty texts, and texts whose tokens don't give back their bytes (U+2581 in them), have no tokens and
count nothing; strings of special tokens are ordinary text; rows that repeat or share an id are rows of their own; a very long
text is aligned in one piece (some hundred bytes of memory a byte); an empty table gives no rows; columns other than doc_id
and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, stored, table, texts
from hazeline.llm.token_files import pack, unpack
from hazeline.llm.units import TOKENIZER, can_be_cut, cuts

PIECES = "piece_bpe_32k.model"
#: Pairs that are looked up where the documents are; a bound of the table that each worker holds.
HEAD = 1 << 18
SIGN = "▁"


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.sep in name else public_tokenizers.path(name)


class ByteTokens:
    """Ids of units by the tokenizers library, special strings as ordinary text, and the bytes of each id."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(_path(name))
        self.library.encode_special_tokens = True
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards (fixed by the format).
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.spelt = [b""] * self.library.get_vocab_size()
        for entry, i in self.library.get_vocab().items():
            self.spelt[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.cut = can_be_cut(name)

    def ids(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]


class PieceTokens:
    """Ids of units, which begin with a space, by the sentencepiece library, and the bytes of each id."""

    def __init__(self, name: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.spelt = [p.replace(SIGN, " ").encode() for p in entries]
        for b in range(256):
            self.spelt[self.library.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        self.cut = not any(re.search(f"[^{SIGN}]{SIGN}", p) for p in entries)
        self.sign = self.library.piece_to_id(SIGN)

    def ids(self, units: list[str]) -> list[list[int]]:
        """The library adds the first space itself, but not to an empty text."""
        found = self.library.encode([u[1:] for u in units], num_threads=1)
        return [x if u != " " else [self.sign] for u, x in zip(units, found, strict=True)]


class _Held:
    """Ids of numbered units end to end."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens.spelt], np.int64)
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, units: list[str], names: list[bytes]) -> np.ndarray:
        """Encodes further units; whether their tokens give back their bytes."""
        found = self.tokens.ids(units)
        n = np.array([len(x) for x in found], np.int64)
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(n)]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))]
        spelt = self.tokens.spelt
        return np.array([b"".join([spelt[i] for i in x]) == y for x, y in zip(found, names, strict=True)], bool)

    def keep(self, numbers: np.ndarray) -> None:
        ids, n = self.gather(numbers)
        self.flat, self.start = ids, np.r_[0, np.cumsum(n)]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and their number by unit."""
        first, n = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        total = np.cumsum(n)
        last = int(total[-1]) if len(total) else 0
        return self.flat[np.arange(last) + np.repeat(first - total + n, n)], n


class TwoTokenizers:
    """Tokens of both tokenizers for batches of texts; units are remembered within a bound."""

    def __init__(self, a: str, b: str, most: int = 500_000):
        self.a, self.b, self.most = _Held(ByteTokens(a)), _Held(PieceTokens(b)), most
        self.cut = self.a.tokens.cut and self.b.tokens.cut
        self.known: dict[bytes, int] = {}
        self.whole = np.zeros(0, bool)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        names = units.to_pylist()
        new = [x for x in names if x not in self.known]
        for at in range(0, len(new), 20_000):
            few = new[at : at + 20_000]
            decoded = [x.decode("utf-8") for x in few]
            ok = self.a.add(decoded, few) & self.b.add(decoded, few)
            self.known.update(zip(few, range(len(self.known), len(self.known) + len(few)), strict=True))
            self.whole = np.r_[self.whole, ok]
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if len(self.known) > self.most:
            self.a.keep(numbers)
            self.b.keep(numbers)
            self.whole = self.whole[numbers]
            self.known = dict(zip(names, range(len(names)), strict=True))
            numbers = np.arange(len(names))
        return numbers

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A end to end, their number a row, ids by B and their number. Rows without tokens have none of either."""
        encoded = [b" " + x.encode("utf-8") if x else b"" for x in rows]
        joined = b"".join(encoded)
        data = np.frombuffer(joined, np.uint8)
        stops = np.cumsum([len(x) for x in encoded]).astype(np.int64)
        if not len(data):
            none = np.zeros(0, np.int32)
            return none, np.zeros(len(rows), np.int64), none, np.zeros(len(rows), np.int64)
        marked = np.zeros(len(data) + 1, bool)
        if self.cut:
            marked[:-1] = cuts(data)[:-1] & (data == 32)
        marked[0] = marked[stops] = True
        bounds = np.flatnonzero(marked).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        row = np.searchsorted(stops, bounds[:-1], side="right")
        broken = np.zeros(len(rows), bool)
        broken[row[~self.whole[number]]] = True
        kept = ~broken[row]
        number, row = number[kept], row[kept]
        a, n_a = self.a.gather(number)
        b, n_b = self.b.gather(number)
        by_row = lambda n: np.bincount(row, n, len(rows)).astype(np.int64)
        return a, by_row(n_a), b, by_row(n_b)


@lru_cache(maxsize=1)
def two_tokenizers(a: str, b: str) -> TwoTokenizers:
    """The encoder of a worker, which remembers units from task to task."""
    return TwoTokenizers(a, b)


def groups(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts among the tokens of A and of B, in order. ends_a, ends_b: ascending byte offsets of the tokens'
    ends over all rows; n_a, n_b: tokens a row (rows without tokens are no intervals)."""
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    some = n_a > 0
    lo, hi = (stop_a - n_a)[some], stop_a[some]
    left, right = (stop_b - n_b)[some], stop_b[some]
    tried = np.zeros(len(lo), np.int64)
    found_a, found_b = [], []
    while len(lo):
        inner = hi - lo - 1  # ends of A inside the interval: lo to hi - 2
        leaf = (tried >= inner) | (right - left < 2)
        if leaf.any():
            found_a.append(lo[leaf])
            found_b.append(left[leaf])
            go = ~leaf
            lo, hi, left, right, tried, inner = lo[go], hi[go], left[go], right[go], tried[go], inner[go]
            if not len(lo):
                break
        # From the middle outwards: 0, +1, -1, +2, -2, ...
        away = (tried + 1) // 2
        i = lo + (inner - 1) // 2 + np.where(tried % 2, away, -away)
        j = np.searchsorted(ends_b, ends_a[i])
        shared = ends_b[j] == ends_a[i]
        i, j, miss = i[shared] + 1, j[shared] + 1, ~shared
        none = np.zeros(len(i), np.int64)
        lo, hi, left, right, tried = (
            np.concatenate([lo[miss], lo[shared], i]),
            np.concatenate([hi[miss], i, hi[shared]]),
            np.concatenate([left[miss], left[shared], j]),
            np.concatenate([right[miss], j, right[shared]]),
            np.concatenate([tried[miss] + 1, none, none]),
        )
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts_a, starts_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(starts_a)
    return starts_a[order], starts_b[order]


@lru_cache(maxsize=1)
def _digits(size: int) -> np.ndarray:
    """The decimal digits of 0 to size - 1, zero bytes before them and one behind."""
    width = len(str(size - 1))
    out = np.zeros((size, width + 1), np.uint8)
    n = np.arange(size)
    for k in range(width):
        power = 10**k
        out[:, width - 1 - k] = np.where((n >= power) | (k == 0), n // power % 10 + 48, 0)
    return out


def group_texts(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """The groups of each row as `a1,a2|b1;a3|b2,b3`."""
    of_a = np.zeros(len(a), np.int64)
    of_a[starts_a] = 1
    of_b = np.zeros(len(b), np.int64)
    of_b[starts_b] = 1
    of_a, of_b = np.cumsum(of_a) - 1, np.cumsum(of_b) - 1
    # A token of A stands behind all tokens of B of earlier groups, a token of B behind those of A of its own group too.
    at_a = np.arange(len(a)) + starts_b[of_a]
    at_b = np.arange(len(b)) + np.r_[starts_a[1:], len(a)][of_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[at_a[np.r_[starts_a[1:], len(a)] - 1]] = ord("|")
    sign[at_b[np.r_[starts_b[1:], len(b)] - 1]] = ord(";")
    stops = np.cumsum(n_a + n_b)
    sign[stops[n_a > 0] - 1] = 0
    rows = _digits(int(ids.max(initial=0)) + 1)[ids]
    rows[:, -1] = sign
    held = rows != 0
    data = rows[held].tobytes()
    places = np.r_[0, np.cumsum(held.sum(axis=1))][np.r_[0, stops]]
    return [data[x:y] for x, y in zip(places, places[1:], strict=False)]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and B of every pair whose bytes overlap: one for each stretch between cuts of either."""
    is_a = np.zeros(int(ends_a[-1]) + 1, bool)
    is_b = is_a.copy()
    is_a[ends_a] = is_b[ends_b] = True
    at = np.flatnonzero(is_a | is_b)
    before = lambda marks: np.cumsum(marks, dtype=np.int64)[at] - marks[at]
    return before(is_a), before(is_b)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, keys_control binary, keys_data binary, counts_control binary, counts_data binary"


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def _align(a_name: str, b_name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = two_tokenizers(a_name, b_name)
    width = len(encoder.b.sizes)
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            a, n_a, b, n_b = encoder.encode(texts(part, "text"))
            n = len(n_a)
            n_groups, n_links, hashes = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            keys, count, owner = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(a):
                ends_a, ends_b = np.cumsum(encoder.a.sizes[a]), np.cumsum(encoder.b.sizes[b])
                starts_a, starts_b = groups(ends_a, ends_b, n_a, n_b)
                n_groups = np.bincount(np.searchsorted(np.cumsum(n_a), starts_a, side="right"), minlength=n)
                hashes = [hashlib.sha256(x).hexdigest() if x else "" for x in group_texts(a, b, starts_a, starts_b, n_a, n_b)]
                i, j = links(ends_a, ends_b)
                row = np.searchsorted(np.cumsum(n_a), i, side="right")
                n_links = np.bincount(row, minlength=n)
                # The distinct pairs of each row with their links, in order.
                paired = np.sort((row << 40) | (a[i].astype(np.int64) * width + b[j]))
                new = np.flatnonzero(np.r_[True, paired[1:] != paired[:-1]])
                count = np.diff(np.r_[new, len(paired)])
                owner, keys = paired[new] >> 40, paired[new] & ((1 << 40) - 1)
            stops = np.searchsorted(owner, np.arange(n + 1))
            out = []
            for k, (x, y) in enumerate(zip(stops, stops[1:], strict=False)):
                packed = (*pack(np.diff(keys[x:y], prepend=0)), *pack(count[x:y] - 1))
                out.append((part.column("doc_id")[k].as_py(), n_a[k], n_b[k], n_groups[k], n_links[k], hashes[k], y - x, *packed))
            schema = _schema(ALIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a row and their links."""
    n = row["n_pairs"]
    keys = np.cumsum(unpack(row["keys_control"], row["keys_data"], n), dtype=np.int64)
    return keys, unpack(row["counts_control"], row["counts_data"], n).astype(np.int64) + 1


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _counts(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: sums over what a task holds, given out when it holds too much."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        found = [_pairs(r) for r in batch.to_pylist()]
        keys, n = _summed(np.concatenate([keys, *(x for x, _ in found)]), np.concatenate([n, *(x for _, x in found)]))
        if len(keys) > most:
            yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])
            keys, n = keys[:0], n[:0]
    yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])


def _scores(keys: np.ndarray, counts: np.ndarray, best: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, key, n, n_best, count_sum: for each row the sums over the pairs of the table (key null), and its other pairs."""
    schema = _schema("row long, key long, n long, n_best long, count_sum long")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            key, n = _pairs(r)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            held = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            at, here = at[held], n[held]
            rare = np.c_[np.full((~held).sum(), r["row"]), key[~held], n[~held]]
            out.append((r["row"], int(here[best[at]].sum()), int((here * counts[at]).sum()), rare))
        rows, n_best, count_sum, rare = zip(*out, strict=True) if out else ((), (), (), ())
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), none, none, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=schema)
        other = np.concatenate(rare) if out else np.zeros((0, 3), np.int64)
        none = pa.nulls(len(other), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(other[:, k], pa.int64()) for k in range(3)), none, none], schema=schema)


def aligned(docs: DataFrame, a: str = TOKENIZER, b: str = PIECES) -> DataFrame:
    """Each row of docs (doc_id, text) aligned, with its distinct id pairs (packed) and row, a number of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(partial(_align, a, b), ALIGNED)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")


def pair_counts(rows: DataFrame) -> DataFrame:
    """key (id of A * the size of B's vocabulary + id of B), n: links corpus-wide."""
    found = rows.select("n_pairs", "keys_control", "keys_data", "counts_control", "counts_data").filter("n_pairs > 0")
    return found.mapInArrow(partial(_counts, 1_000_000), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _least_of_head(counts: DataFrame, head: int) -> int:
    """A count that head pairs at most reach: eight steps to a doubling, so that a few hundred rows tell."""
    step = F.floor(F.log2(F.col("n")) * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for r in steps:
        total += r["pairs"]
        if total > head:
            break
        least = r["least"]
    return least


def alignment_scores(rows: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """row, n_best, count_sum of aligned rows; width: the size of B's vocabulary."""
    counts = stored(pair_counts(rows), "pair-counts")
    other = F.col("key") % width
    # A row for each id of B: bounded by the vocabulary, whatever the corpus.
    best = counts.groupBy(other.alias("_b")).agg(F.max("n").alias("_most"))
    marked = counts.join(F.broadcast(best), other == F.col("_b")).select("key", F.col("n").alias("count"), (F.col("n") == F.col("_most")).alias("best"))
    marked = stored(marked, "marked-pairs")
    least = _least_of_head(counts, head)
    top = marked.filter(F.col("count") >= least).orderBy("key").toArrow()  # HEAD rows at most
    table_of = [top.column(c).to_numpy() for c in ("key", "count", "best")]
    schema = "row long, key long, n long, n_best long, count_sum long"
    found = rows.select("row", "n_pairs", "keys_control", "keys_data", "counts_control", "counts_data")
    found = stored(found.mapInArrow(partial(_scores, *table_of), schema), "scores")
    rare = found.filter("key is not null").select("row", "key", "n").join(marked.filter(F.col("count") < least), "key")
    rare = rare.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    both = found.filter("key is null").select("row", "n_best", "count_sum").union(rare)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(table(spark, sf_dir, "documents"))
    scores = alignment_scores(rows, len(PieceTokens(PIECES).spelt))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, "row").select(*columns)
