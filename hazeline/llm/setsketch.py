"""Near duplicates by SetSketch registers (Ertl 2021).

A document is the set of its SHINGLE-word shingles. Register k holds the least of the set's exponential variates (rate RATE)
on a scale of powers of BASE, truncated to 16 bits; registers of a union are the larger of each pair, and two
registers are equal with about the Jaccard similarity. Runs of ROWS registers are bands; sets that share a band are
candidates. A pair's similarity is estimated jointly from the registers that are greater, less and equal, by the likelihood
given both sizes, and a pair goes on unless the threshold is out by SURE in log-likelihood. Links are confirmed on whole sets.

Only classes are asked for, so a group isn't compared pair by pair. (1) Each set of a band's bucket is compared with the
bucket's least set, its leader: first with the leader it is likest to, then with those of other classes. (2) Buckets that still
hold several classes besides their leader have the pairs across classes compared, in blocks; what links there are join labels of
classes, a row a class and cell. So every candidate pair is
confirmed, rejected, or inside one class already; the bands miss a pair at the threshold once in 300,000.

Defined cases: A-Z are lowered, words are split at ASCII white space; fewer than SHINGLE words are one shingle; null texts and
texts without words have no set, link to nothing and are kept; equal sets are copies and link, also where they share a doc_id;
a null doc_id counts as the greatest, so it stands for a class of such rows alone; rows that repeat have the same result; very
long texts are whole sets; columns beyond doc_id and text don't matter, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import mix64, pieces, stored, table, texts
from hazeline.llm.components import components
from hazeline.llm.jaccard import _cells, _overlaps
from hazeline.llm.shingles import set_ids, shingle_sets

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_535
SURE = 12.0
#: Equal registers of a pair in a bucket's blocks: at the threshold fewer occur once in 10^11.
LEAST_EQUAL = 50
BLOCK = 2_000
LAST_ID = (1 << 63) - 1
_PERMUTATIONS = mix64(np.arange(501, 501 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
_STEPS = np.linspace(0, 1, 129)


def registers(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of registers for each set of hashes (end to end, n a set); zeros for an empty set."""
    out = np.zeros((len(n), REGISTERS), np.uint16)
    full = np.flatnonzero(n)
    if len(full):
        first = (np.cumsum(n) - n)[full]
        for k, p in enumerate(_PERMUTATIONS):
            least = np.minimum.reduceat(hashes * p, first)
            variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
            out[full, k] = np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions of sets."""
    return np.maximum(a, b)


def likelihoods(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and by how much the likeliest one at the threshold or above falls short of it in
    log-likelihood (infinity where the sizes rule it out). more, less: registers of a that are greater, less than b's."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    at = most[:, None] * _STEPS
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(np.maximum(u[:, None] - v[:, None] * at, 0)), chance(np.maximum(v[:, None] - u[:, None] * at, 0))
    log = lambda p: np.log(np.maximum(p, 1e-9))
    equal = REGISTERS - more - less
    total = more[:, None] * log(up) + less[:, None] * log(down) + equal[:, None] * log(1 - up - down)
    reached = np.where(at >= threshold - 1e-12, total, -np.inf).max(axis=1)
    return at[np.arange(len(at)), total.argmax(axis=1)], total.max(axis=1) - reached


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([x.encode("utf-8", "surrogatepass").lower() for x in texts(batch, "text")], SHINGLE)


DESCRIBED = "doc_id long, text_key long, set_id binary, n int, registers binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 21):
            hashes, n = _sets(part)
            sketch = [x.tobytes() for x in registers(hashes, n)]
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(set_ids(hashes, n), pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "set_id", "n", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _matrix(batch.column("registers")).reshape(-1, BANDS, ROWS).astype(np.uint64)
        packed = (values << (np.uint64(16) * np.arange(ROWS, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
        keys = mix64(packed + mix64(np.arange(1, BANDS + 1, dtype=np.uint64)))
        flat = pa.array(keys.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.record_batch([batch.column("set_id"), lists], names=["set_id", "bands"])


def _likely(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leader, set_id, estimate of the pairs that the likelihood doesn't rule out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b = _matrix(part.column("registers_a")), _matrix(part.column("registers_b"))
            n_a, n_b = (part.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            estimate, short = likelihoods(n_a, n_b, (a > b).sum(axis=1), (a < b).sum(axis=1), threshold)
            keep = pa.array(np.flatnonzero(short <= SURE))
            columns = [part.column("leader").take(keep), part.column("set_id").take(keep), pa.array(estimate).take(keep)]
            yield pa.record_batch(columns, names=["leader", "set_id", "estimate"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 21):
            hashes, n = _sets(part)
            offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
            yield pa.record_batch([pa.array(set_ids(hashes, n), pa.binary()), lists], names=["set_id", "shingles"])


def _whole_sets(rows: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, shingles of the wanted sets, from one text of each."""
    first = wanted.select("set_id").distinct().join(sets.select("set_id", "first_id", "first_key"), "set_id").select("first_id", "first_key").hint("shuffle_hash")
    found = rows.join(first, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key")), "left_semi").select("text")
    return stored(found.mapInArrow(_shingles, "set_id binary, shingles array<bigint>").dropDuplicates(["set_id"]), "whole-sets", compression="zstd")


def _confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (leader, set_id, ...) whose whole sets reach the threshold."""
    b = whole.select("set_id", F.col("shingles").alias("b"))
    a = whole.select(F.col("set_id").alias("leader"), F.col("shingles").alias("a"))
    both = F.size(F.array_intersect("a", "b"))
    reached = (100 + percent) * both >= percent * (F.size("a") + F.size("b"))
    return pairs.join(b, "set_id").join(a, "leader").filter(reached).select(pairs.columns)


def _distinct(described: DataFrame) -> DataFrame:
    """The distinct sets with their copies and the first text that has each."""
    pick = F.min_by(F.struct("n", "registers", F.col("text_key").alias("first_key")), F.struct("doc_id", "text_key")).alias("s")
    sets = described.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), pick)
    return stored(sets.select("set_id", "first_id", "copies", "s.*"), "distinct-sets", compression="zstd")


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("leader").alias("a"), F.col("set_id").alias("b")))


def _across(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell with a partner of another class by size and equal registers."""
    for cell in _cells(batches):
        left, right, pairs = _other_classes(cell)
        n = cell.column("n").to_numpy().astype(np.float64)
        pairs &= (n[left][:, None] >= threshold * n[right][None]) & (n[right][None] >= threshold * n[left][:, None])
        sketch = _matrix(cell.column("registers").combine_chunks())
        equal = np.zeros(pairs.shape, np.uint8)
        for k in range(REGISTERS):
            equal += sketch[left, k][:, None] == sketch[right, k][None]
        pairs &= equal >= LEAST_EQUAL
        keep = np.union1d(left[pairs.any(axis=1)], right[pairs.any(axis=0)])
        if len(keep):
            yield from cell.take(pa.array(keep)).drop_columns(["registers", "n"]).combine_chunks().to_batches()


def _other_classes(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block, a, b = cell.column("block").to_numpy(), cell.column("a")[0].as_py(), cell.column("b")[0].as_py()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    _, label = _classes(cell)
    return left, right, label[left][:, None] != label[right][None]


def _classes(cell: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The labels of a cell in ascending order, and each row's place among them."""
    labels = cell.column("label").to_pylist()
    names = sorted(set(labels))
    place = dict(zip(names, range(len(names)), strict=True))
    return names, np.array([place[x] for x in labels])


def _cell_links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leader, set_id: each class of a cell, by its label, with the least class that links lead to in the cell: a row a class at most."""
    for cell in _cells(batches):
        left, right, pairs = _other_classes(cell)
        values = [x.values.to_numpy().view(np.uint64) for x in cell.column("shingles").combine_chunks()]
        n = np.array([len(v) for v in values], np.float64)
        linked = pairs & ((100 + percent) * _overlaps(values, left, right) >= percent * (n[left][:, None] + n[right][None]))
        names, label = _classes(cell)
        i, j = np.nonzero(linked)
        both = np.unique(label[left[i]].astype(np.int64) * len(names) + label[right[j]])
        least = _least(both // len(names), both % len(names), len(names))
        joined = np.flatnonzero(least < np.arange(len(names)))
        if len(joined):
            columns = [pa.array([names[x] for x in least[joined]], pa.binary()), pa.array([names[x] for x in joined], pa.binary())]
            yield pa.record_batch(columns, names=["leader", "set_id"])


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers under n that the links (a, b) join each of them to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        near = np.minimum(least[a], least[b])
        np.minimum.at(least, a, near)
        np.minimum.at(least, b, near)
        least = least[least]
        if (least == before).all():
            return least


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes besides their leader, dealt into cells of two blocks."""
    held = members.filter(F.col("set_id") != F.col("leader")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    held = held.select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
    several = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    rows = held.join(several.select("key", "size"), "key").join(sets.select("set_id", "n", "registers"), "set_id")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit("block")), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    return rows.select(F.col("key").alias("node"), "a", "b", "block", "set_id", "label", "n", "registers")


def _links_across(members: DataFrame, labels: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame | None:
    """Links (leader, set_id) that join the classes of buckets which hold several besides their leader."""
    key = ["node", "a", "b"]
    cells = _rest(members, labels, sets).repartition(*key).sortWithinPartitions(*key)
    near = stored(cells.mapInArrow(partial(_across, percent / 100), "node long, a int, b int, block int, set_id binary, label binary"), "cell-rows")
    if not near.limit(1).count():
        return None
    both = near.join(_whole_sets(rows, sets, near), "set_id").select(*key, "block", "set_id", "label", "shingles")
    last = both.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_cell_links, percent), "leader binary, set_id binary")
    return stored(last, "links")


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    described = stored(rows.mapInArrow(_describe, DESCRIBED), "set-sketches", compression="zstd")
    sets = _distinct(described)

    banded = sets.select("set_id", "registers").mapInArrow(_bands, "set_id binary, bands array<bigint>")
    banded = stored(banded, "bands").select("set_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("set_id").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    members = stored(banded.join(buckets.select("key", "leader"), "key"), "bucket-members")
    pairs = members.filter(F.col("set_id") != F.col("leader")).select("leader", "set_id").distinct()
    side = lambda s, name: sets.select(F.col("set_id").alias(name), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"registers_{s}"))
    pairs = pairs.join(side("b", "set_id"), "set_id").join(side("a", "leader"), "leader")
    pairs = pairs.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    likely = stored(pairs.mapInArrow(partial(_likely, percent / 100), "leader binary, set_id binary, estimate double"), "likely-pairs")

    ends = likely.select("set_id").union(likely.select("leader"))
    whole = _whole_sets(rows, sets, ends)
    likest = likely.groupBy("set_id").agg(F.max_by("leader", F.struct("estimate", "leader")).alias("leader"))
    links = stored(_confirmed(likest, whole, percent), "links")
    labels = _labels(links)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))
    apart = likely.join(of("leader"), "leader", "left").join(of("set_id"), "set_id", "left")
    apart = apart.select("leader", "set_id", *[F.coalesce(f"label_{c}", c).alias(f"label_{c}") for c in ("leader", "set_id")])
    more = _confirmed(apart.filter("label_leader <> label_set_id"), whole, percent)
    # A link joins two classes whole, so it is one of their labels, however many of their sets are linked.
    more = stored(more.select(F.col("label_leader").alias("leader"), F.col("label_set_id").alias("set_id")).distinct(), "links")
    if more.limit(1).count():
        links = links.union(more)
        labels = _labels(links)

    last = _links_across(members, labels, sets, rows, percent)
    if last is not None:
        labels = _labels(links.union(last))

    classed = sets.select("set_id", "first_id", "copies").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    classed = classed.filter((F.col("copies") > 1) | F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "set_id"))
    least = classed.groupBy("label").agg(F.min("first_id").alias("component"))
    found = classed.join(least, "label").select(F.col("set_id").alias("_set"), "component")
    out = described.join(found, (F.col("set_id") == F.col("_set")) & (F.col("n") > 0), "left")
    none = lambda c: F.when(c < LAST_ID, c)
    component = F.coalesce("component", "doc_id")
    return out.select(none(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), none(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
