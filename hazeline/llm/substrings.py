"""Substring deduplication by content-defined chunks of a gear rolling hash.

A gear hash rolls over the bytes of each text. Chunks may start at the places that follow content alone: at
every word and, inside runs of over LONG_WORD bytes without a separator, at the characters before which the
hash ends in three zero bits (every eighth on average). A chunk starts at a place whose hash is the least among
the REACH places to either side, so an insertion moves the chunks beside it and no others. Chunks are keyed by
digest; one that also occurs in an earlier document, by doc_id, repeats. Runs of adjacent repeated chunks with
MIN_WORDS places or more are spans that deduplication removes, so the first document keeps the passage, and
single chunks that recur by chance stay.

With chunks of 7 places on average, a repeated passage of 50 words holds whole chunks of over MIN_WORDS
words wherever it stands; the words at its ends that share a chunk with other text remain. In texts without
separators the same holds for passages of some 400 bytes.

Only digests, ids and positions are shuffled. Counts by digest are combined before the shuffle; the join
back is an equi-join that Spark may split at a hot digest.

Defined cases: null, empty and blank texts have no chunk; a document is a doc_id with a text, so texts that
share a doc_id, or have none, are documents of their own (in the order of their text_key) and rows that repeat are one; a null
doc_id counts as the smallest; passages repeated within one document stay; extra columns are kept whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import mix64, pieces, stored, table, texts, unused

REACH, MIN_WORDS, LONG_WORD = 3, 15, 32
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Bytes that a gear hash of 32 bits remembers when it shifts by 2.
_MEMORY = 16
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
CHUNKS = "doc_id long, text_key long, chunk_from int, chunk_to int, n_words int, digest long"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of gear[byte] << 2 * age over the last 16 bytes."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(2 * step)  # the right side is evaluated first
    return h * np.uint32(0x9E3779B1)


def _places(data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks may start: words, and characters inside long words that the hash of the bytes before picks."""
    size = ends - starts - LONG_WORD
    long_words = np.flatnonzero(size > 0)
    if not len(long_words):
        return starts
    n = size[long_words]
    inside = np.repeat(starts[long_words] + LONG_WORD, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inside = inside[(h[inside - 1] >> np.uint32(29) == 0) & (data[inside] & 0xC0 != 0x80)]
    return np.sort(np.r_[starts, inside])


def chunk(rows: list[str]) -> tuple[np.ndarray, ...]:
    """row, from, to (bytes), places and digest of every chunk of rows."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in rows]
    gap = b"\n" * _MEMORY
    joined = gap + gap.join(encoded) + gap
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(x) for x in encoded], np.int64)
    row_from = np.cumsum(sizes + _MEMORY) - sizes
    space = _SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    rolled = gear_hash(data)
    at = _places(data, rolled, starts, ends)
    word = np.searchsorted(starts, at, side="right") - 1
    row = np.searchsorted(row_from, at, side="right") - 1
    h = rolled[at - 1].astype(np.int64)
    least = np.ones(len(at), bool)
    for k in range(1, REACH + 1):
        same = row[k:] == row[:-k]
        least[k:] &= ~same | (h[k:] < h[:-k])
        least[:-k] &= ~same | (h[:-k] <= h[k:])
    least[0] = True
    least[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(least)
    last = np.append(first[1:], len(at)) - 1
    a = at[first]
    # A chunk ends with the word of its last place, or in that word where the next chunk starts.
    b = ends[word[last]]
    b[:-1] = np.minimum(b[:-1], a[1:])
    view = memoryview(joined)
    digest = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
    owner = row[first]
    # A chunk reaches to the start of the next one, so that adjacent chunks touch.
    following = np.append(a[1:], 0)
    to = np.where(np.append(owner[1:], -1) == owner, following, b)
    return owner, a - row_from[owner], to - row_from[owner], last - first + 1, digest.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            row, start, end, n, digest = chunk(texts(part, "text"))
            yield pa.record_batch(
                [
                    part.column("doc_id").take(pa.array(row)),
                    part.column("text_key").take(pa.array(row)),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                    pa.array(n, pa.int32()),
                    pa.array(digest, pa.int64()),
                ],
                names=["doc_id", "text_key", "chunk_from", "chunk_to", "n_words", "digest"],
            )


def chunks(docs: DataFrame) -> DataFrame:
    """The chunks of docs (doc_id, text); the smallest long stands for a null doc_id. text_key tells texts
    with the same doc_id apart."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(_chunks, CHUNKS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, first_doc_id, byte_from, byte_to, n_words, n_chunks of each span that repeats earlier text.

    text_key is xxhash64 of the text; n_words counts the places of the span. first_doc_id is the smallest document that holds a chunk of the span; bytes are of the UTF-8 text.
    """
    found = stored(chunks(docs), "chunks", compression="zstd")
    document = F.struct("doc_id", "text_key")
    holders = found.groupBy("digest").agg(F.min(document).alias("first"), F.max(document).alias("last"))
    shared = holders.filter(F.col("first") < F.col("last")).select("digest", "first", F.col("first.doc_id").alias("first_doc_id"))
    repeats = found.join(shared, "digest").filter(document > F.col("first")).drop("digest", "first")
    repeats = repeats.groupBy("doc_id", "text_key", "chunk_from", "chunk_to", "n_words").agg(F.min("first_doc_id").alias("first_doc_id"))
    along = Window.partitionBy("doc_id", "text_key").orderBy("chunk_from", "chunk_to")
    breaks = F.when(F.lag("chunk_to").over(along) == F.col("chunk_from"), 0).otherwise(1)
    runs = repeats.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(along))
    spans = runs.groupBy("doc_id", "text_key", "_run").agg(
        F.min("first_doc_id").alias("first_doc_id"),
        F.min("chunk_from").cast("long").alias("byte_from"),
        F.max("chunk_to").cast("long").alias("byte_to"),
        F.sum("n_words").alias("n_words"),
        F.count("*").alias("n_chunks"),
    )
    none = lambda c: F.when(F.col(c) > -(1 << 63), F.col(c)).alias(c)
    spans = spans.filter(F.col("n_words") >= min_words)
    return spans.select(none("doc_id"), "text_key", none("first_doc_id"), "byte_from", "byte_to", "n_words", "n_chunks")


def _without(spans: list[dict], text: str) -> str:
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    for s in sorted(spans, key=lambda s: s["byte_from"]):
        out.append(data[at : s["byte_from"]])
        at = s["byte_to"]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _cut(text_at: int, n_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.num_columns - 1).to_pylist()
        old = batch.column(text_at).to_pylist()
        new = [_without(s, x) if s and x is not None else x for s, x in zip(spans, old, strict=True)]
        columns = batch.columns[:-1]
        columns[text_at] = pa.array(new, columns[text_at].type)
        if n_at >= 0:
            counts = zip(columns[n_at].to_pylist(), new, spans, strict=True)
            columns[n_at] = pa.array([len(x) if s and x is not None else n for n, x, s in counts], columns[n_at].type)
        yield pa.record_batch(columns, names=batch.schema.names[:-1])


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the spans; n_chars, where there is such a column, follows the text."""
    per = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("byte_from", "byte_to")).alias("spans"))
    d, t, s = (unused(docs, x) for x in ("of_doc", "of_text", "spans"))
    per = per.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("spans").alias(s)).hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t))
    joined = docs.join(per, same, "left").select(*[docs[c] for c in docs.columns], s)
    n_at = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else -1
    return joined.mapInArrow(partial(_cut, docs.columns.index("text"), n_at), docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def deduplicated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated spans; those of which nothing is left go."""
    return remove_spans(docs, repeated_spans(docs)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
