"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank in the corpus, most frequent first, so that the commonest 256 take one
byte. Each rank is written in 1 to 4 little-endian bytes; two bits give its length, four lengths to a
control byte, and control and data bytes lie apart. numpy decodes a block with one table lookup from
control bytes to lengths and one gather for each of the four byte positions.

On disk: folder/ranks (Parquet: rank, id) and folder/blocks (Parquet, a row a block: part, seq, before,
doc_ids, lengths, control, data). Blocks are in ascending (part, seq), documents in ascending doc_id
(null first; repeated doc_ids by their ids); before counts the ids of earlier blocks of the part.

Defined cases: null and empty text give the end id alone; an empty table gives no block and no row.
Documents are spread over parts by ranges of doc_id, so hot sources or copies change nothing; a very long
document takes a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, shared_dir, stored, table, texts
from hazeline.llm.units import TOKENIZER, tokenizer, unit_encoder

END_ID = 0
BLOCK_IDS = 1 << 18
BLOCKS = (
    "part int, seq int, before long, n_ids long, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
)

#: Lengths of the four codes that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    extra = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    codes = np.zeros((len(v) + 3) // 4 * 4, dtype=np.uint8)
    codes[: len(v)] = extra
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encode(name: str, end_id: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = unit_encoder(name)
    for batch in batches:
        for part in pieces(batch, "text"):
            ids, n = encoder.encode(texts(part, "text"))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            offsets = np.r_[0, np.cumsum(n) * ids.itemsize].astype(np.int32)
            rows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), rows], names=["doc_id", "ids"])


def _flat(rows: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all rows of a binary column end to end, and where each row starts and the last ends."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = rows.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(width) if data else np.zeros(0, width)
    return values, (offsets - offsets[0]) // width.itemsize


def _frequencies(width: np.dtype, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            n = np.bincount(_flat(batch.column("ids"), width)[0], minlength=len(total))
            n[: len(total)] += total
            total = n
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _write_blocks(width: np.dtype, rank_of: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    rows: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        values = rank_of[np.concatenate(rows)]
        control, data = pack(values)
        row = {
            "part": part, "seq": seq, "before": before, "n_ids": len(values), "doc_ids": docs,
            "lengths": [len(x) for x in rows], "control": control, "data": data,
        }
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    for batch in batches:
        if not batch.num_rows:
            continue
        values, at = _flat(batch.column("ids"), width)
        for doc_id, row in zip(batch.column("doc_id").to_pylist(), np.split(values, at[1:-1]), strict=True):
            if held and held + len(row) > BLOCK_IDS:
                yield block()
                seq, before, docs, rows, held = seq + 1, before + held, [], [], 0
            docs.append(doc_id)
            rows.append(row)
            held += len(row)
    if docs:
        yield block()


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("lengths", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())]
)


def write_token_files(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int | None = END_ID) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write them to folder."""
    width = np.dtype("<u2") if tokenizer(name).get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    encoded = docs.select("doc_id", "text").mapInArrow(partial(_encode, name, end_id), "doc_id long, ids binary")
    encoded = stored(encoded, "token-ids", compression="zstd")
    counts = encoded.select("ids").mapInArrow(partial(_frequencies, width), "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # The rank table has a row for each id of the vocabulary at most, whatever the corpus.
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark = docs.sparkSession
    spark.createDataFrame([(r, i) for r, i in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(partial(_write_blocks, width, rank_of), BLOCKS).write.parquet(f"{folder}/blocks")


def _read(ids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            values = ids[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4", copy=False)
            size = np.array(row["lengths"], np.int64)
            start = np.cumsum(size) - size
            rows = np.split(values, start[1:])
            yield pa.record_batch(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["part"]] * len(size), pa.int32()),
                    pa.array(start + row["before"]),
                    pa.array(size),
                    pa.array([x.tobytes() for x in rows], pa.binary()),
                ],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )


def _digested(ids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(ids, batches):
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        yield batch.drop_columns(["ids"]).append_column("ids_crc32", crc)


def read_token_files(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit; or ids_crc32) of each document."""
    ids = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    last = "ids_crc32 long" if digests else "ids binary"
    schema = f"doc_id long, part int, start_in_part long, n_tokens long, {last}"
    docs = blocks.mapInArrow(partial(_digested if digests else _read, ids), schema)
    # One row a part: as many as write_token_files had partitions, so the window and the broadcast stay small.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("part").alias("of_part"), earlier.alias("base"))
    joined = docs.join(F.broadcast(bases), F.col("part") == F.col("of_part"))
    return joined.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", last.split()[0])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, digests=True)
