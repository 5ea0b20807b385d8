"""Jaccard similarity join of word-shingle sets by chosen paths.

Documents are sets of SHINGLE-word shingles. A run samples from each set the shingles whose hash lies under
1 / (threshold * size), so two sets that reach the threshold expect one sampled shingle in common; every
sampled shingle is a node that holds the sets which sampled it. A node with more than SMALL sets whose
mean similarity is low is split again on pairs of sampled min-hash coordinates, up to DEPTH times; every other
node is a leaf, and its pairs are compared. Runs repeat until the chance that a pair at the threshold has met is
TARGET_RECALL. (Christiani and Pagh 2017; Christiani, Pagh and Sivertsen 2018.)

Comparing is exact: leaves filter pairs by size and by a 64-byte min-hash sketch (which loses a pair at the
threshold once in about a million), and the rest are verified on their whole shingle sets. A pair that
shares several leaves is compared in the first alone, so links are counted once and no pair is ever a
row: a leaf gives, for each set, the number of its links and one link to the least set around it. Leaves
over BLOCK sets are cut into blocks whose combinations are compared in separate tasks.

Defined cases: texts are lower-cased and words split at white space; texts of one to four words are one
shingle; null texts and texts without words link to nothing and are their own class; documents with equal
sets are copies, linked to each other, also where they share a doc_id; a null doc_id counts as the smallest;
of several texts with one doc_id the one with the least digest is first; very long texts are whole sets; extra
columns don't matter, whatever their names; an empty table gives an empty result. The pipeline stage keeps one
row of each class: the first text of the least doc_id, once where rows repeat; rows without words all stay.

The number of links of a set is exact, so inside one dense group of sets that all differ the comparisons are
quadratic in the sets (not in their copies); they are dealt to tasks by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import mix64, pieces, stored, table, texts, unused
from hazeline.llm.components import components
from hazeline.llm.shingles import BASE, set_ids, shingle_sets

SHINGLE, THRESHOLD = 5, 0.8
TARGET_RECALL = 0.9999
SMALL, BLOCK, DEPTH = 2_000, 2_500, 3
#: Samplings of a node that is split again: a pair at the threshold passes one of them with 0.8 * 0.8, all but 1 in 20 one of three.
SAMPLINGS = 3
SKETCH, LEAST_MATCHES = 64, 36
#: A large node is split only while the mean similarity of its sets is under this.
DENSE = 0.4
NO_ID = -(1 << 63)
#: Types of the columns that choose among rows that repeat.
_PLAIN = ("string", "bigint", "int", "double", "boolean", "date", "timestamp")

_PERMUTATIONS = mix64(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)


def runs(recall: float = TARGET_RECALL) -> int:
    """Runs after which a pair at the threshold has met with this probability, even if its nodes are split at every level.

    Of one run it shares a sampled shingle with 1 - 1/e, and passes each split with 1 - (1 - 0.8 * 0.8) ** SAMPLINGS."""
    met = (1 - math.exp(-1)) * (1 - (1 - THRESHOLD**2) ** SAMPLINGS) ** DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _lower(rows: list[str]) -> list[bytes]:
    return [x.lower().encode("utf-8", "surrogatepass") for x in rows]


SETS = "doc_id long, text_key long, set_id binary, n int, sketch binary, nodes array<bigint>"


def _describe(n_runs: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = mix64(np.arange(1001, 1001 + n_runs, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for part in pieces(batch, "text", 1 << 21):
            hashes, n = shingle_sets(_lower(texts(part, "text")), SHINGLE)
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            owner = np.repeat(np.arange(len(n)), n)
            sketch = np.zeros((len(n), SKETCH), np.uint8)
            if len(full):
                for k, p in enumerate(_PERMUTATIONS):
                    least = np.minimum.reduceat(hashes * p, first)
                    sketch[full, k] = (least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)
            rate = np.minimum(2.0**64 / (threshold * np.maximum(n, 1)), 2.0**64 - 2048).astype(np.uint64)[owner]
            nodes: list[list[int]] = [[] for _ in range(len(n))]
            for r, seed in enumerate(seeds):
                chosen = np.flatnonzero(hashes * seed < rate)
                node = mix64(hashes[chosen] + np.uint64((r + 1) * BASE % (1 << 64))).view(np.int64)
                for i, x in zip(owner[chosen].tolist(), node.tolist(), strict=True):
                    nodes[i].append(x)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array(set_ids(hashes, n), pa.binary()),
                    pa.array(n, pa.int32()),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array(nodes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "set_id", "n", "sketch", "nodes"],
            )


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each row of a large node goes to: for each sampling two min-hash coordinates that the node's hash
    chooses, so that a token that most sets of the node share seldom keeps them together."""
    sampling = mix64(np.arange(1, SAMPLINGS + 1, dtype=np.uint64))
    for batch in batches:
        node = batch.column("node").to_numpy().view(np.uint64)
        sketch = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("sketch")]).reshape(-1, SKETCH)
        rows = np.arange(len(node))
        children = []
        for i, salt in enumerate(sampling):
            h = mix64(node ^ salt)
            first = (h % np.uint64(SKETCH)).astype(np.int64)
            second = (first + 1 + ((h >> np.uint64(32)) % np.uint64(SKETCH - 1)).astype(np.int64)) % SKETCH
            value = sketch[rows, first].astype(np.uint64) * np.uint64(256) + sketch[rows, second]
            children.append(mix64(node + (value + np.uint64(i * 65536 + 1)) * np.uint64(BASE)))
        out = batch.take(pa.array(np.tile(rows, SAMPLINGS)))
        child = pa.array(np.concatenate(children).view(np.int64))
        yield out.set_column(out.schema.get_field_index("node"), "node", child)


def _mean_similarity(members: DataFrame) -> DataFrame:
    """node, similarity: the mean share of equal min-hash bytes over the pairs of a node, on 8 coordinates."""
    byte = lambda k: F.hex(F.substring("sketch", k + 1, 1))
    tall = members.select("node", F.posexplode(F.array(*[byte(k) for k in range(0, SKETCH, SKETCH // 8)])))
    counts = tall.groupBy("node", "pos", "col").agg(F.count("*").cast("double").alias("c"))
    squares = counts.groupBy("node").agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.sum("c").alias("n"))
    return squares.select("node", (8 * F.col("s") / (F.col("n") * F.col("n"))).alias("similarity"))


def leaves(sets: DataFrame) -> DataFrame:
    """node, size, set_id for the members of all leaves with two sets or more."""
    level = sets.select("set_id", "sketch", F.explode("nodes").alias("node"))
    found = None
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
        members = stored(level.join(sizes, "node"), "nodes")
        large = members.filter(F.col("size") > SMALL)
        if depth == DEPTH or not large.limit(1).count():
            last = members.select("node", "size", "set_id")
            return last if found is None else found.union(last)
        sparse = stored(_mean_similarity(large).filter(F.col("similarity") < DENSE).select("node"), "sparse-nodes")
        here = members.join(sparse, "node", "left_anti").select("node", "size", "set_id")
        found = here if found is None else found.union(here)
        split = large.join(sparse, "node", "left_semi").select("set_id", "sketch", "node")
        level = split.mapInArrow(_children, "set_id binary, sketch binary, node long")
    return found


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (node, a, b); rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("node", "a", "b")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            key = tuple(k[start] for k in keys)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _share_nothing(patterns: dict[tuple, int]) -> np.ndarray:
    """A matrix of the pairs of patterns (tuples of leaves, by their number) without a leaf in common; in steps of 1,024 leaves."""
    size = np.array([len(p) for p in patterns], np.int64)
    leaf = np.fromiter((x for p in patterns for x in p), np.int64, int(size.sum()))
    owner = np.repeat(np.fromiter(patterns.values(), np.int64, len(patterns)), size)
    _, code, count = np.unique(leaf, return_inverse=True, return_counts=True)
    often = count > 1  # a leaf of one pattern alone meets no other
    place = (np.cumsum(often) - 1)[code]
    order = np.argsort(place[often[code]], kind="stable")
    place, owner = place[often[code]][order], owner[often[code]][order]
    shared = np.zeros((len(patterns), len(patterns)), np.float32)
    for start in range(0, int(often.sum()), 1024):
        lo, hi = np.searchsorted(place, [start, start + 1024])
        m = np.zeros((len(patterns), 1024), np.float32)
        m[owner[lo:hi], place[lo:hi] - start] = 1
        shared += m @ m.T
    new = shared == 0
    new[np.arange(len(size)), np.arange(len(size))] = size == 0
    return new


def _first_meetings(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of the two sides of a cell and a matrix of their pairs that share no earlier leaf."""
    node, a, b = (cell.column(c)[0].as_py() for c in ("node", "a", "b"))
    block = cell.column("block").to_numpy()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    patterns: dict[tuple, int] = {}
    of = np.array([patterns.setdefault(tuple(x for x in xs if x < node), len(patterns)) for xs in cell.column("leaves").to_pylist()])
    new = _share_nothing(patterns)
    if not new.any():
        return None
    pairs = new[np.ix_(of[left], of[right])]
    if a == b:
        np.fill_diagonal(pairs, False)
    return (left, right, pairs) if pairs.any() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a partner by size and sketch, met here first."""
    for cell in _cells(batches):
        met = _first_meetings(cell)
        if met is None:
            continue
        left, right, pairs = met
        n = cell.column("n").to_numpy().astype(np.float64)
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        pairs &= (n[left][:, None] >= THRESHOLD * n[right][None]) & (n[right][None] >= THRESHOLD * n[left][:, None])
        equal = np.zeros(pairs.shape, np.uint8)
        for k in range(SKETCH):
            equal += sketch[left, k][:, None] == sketch[right, k][None]
        pairs &= equal >= LEAST_MATCHES
        keep = np.union1d(left[pairs.any(axis=1)], right[pairs.any(axis=0)])
        if len(keep):
            out = cell.take(pa.array(keep)).drop_columns(["sketch"]).combine_chunks()
            yield from out.to_batches()


#: Shingles that are compared at once.
MOST_AT_ONCE = 2_000_000


def _overlaps(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets (ascending unsigned hashes) of left with those of right, by ranges of hashes."""
    parts = -(-sum(map(len, values)) // MOST_AT_ONCE)
    if parts <= 1:
        return _overlaps_at_once(values, left, right)
    total = np.zeros((len(left), len(right)), np.float32)
    bounds = [np.uint64(k * (1 << 64) // parts) for k in range(1, parts)]
    cut = [np.r_[0, np.searchsorted(v, bounds), len(v)] for v in values]
    for k in range(parts):
        total += _overlaps_at_once([v[c[k] : c[k + 1]] for v, c in zip(values, cut, strict=True)], left, right)
    return total


def _overlaps_at_once(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(values) <= 3:
        return np.array([[len(np.intersect1d(values[i], values[j], assume_unique=True)) for j in right] for i in left], np.float32)
    flat = np.concatenate(values)
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone meets nothing
    place = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 1024
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(code, [start, start + width])
        m = np.zeros((len(values), width), np.float32)
        m[row[lo:hi], code[lo:hi] - start] = 1
        total += m[left] @ m[right].T
    return total


LINKS = "set_id binary, least binary, n_links long, n_docs long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a cell with a link: the least set around it, its links and the documents behind them."""
    for cell in _cells(batches):
        met = _first_meetings(cell)
        if met is None:
            continue
        left, right, pairs = met
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("shingles").combine_chunks()]
        n = np.array([len(v) for v in values], np.float32)
        linked = pairs & (_overlaps(values, left, right) * (1 + THRESHOLD) >= THRESHOLD * (n[left][:, None] + n[right][None]) - 1e-3)
        if not linked.any():
            continue
        ids = cell.column("set_id").to_pylist()
        order = np.argsort(np.array([int.from_bytes(x, "big") for x in ids], object))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        copies = cell.column("copies").to_numpy()
        label = place.copy()
        while True:  # the least place in each component of the cell
            before = label.copy()
            around = np.where(linked, label[right][None], len(ids)).min(axis=1, initial=len(ids))
            label[left] = np.minimum(label[left], around)
            around = np.where(linked, label[left][:, None], len(ids)).min(axis=0, initial=len(ids))
            label[right] = np.minimum(label[right], around)
            if (label == before).all():
                break
        links, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        links[left] += linked.sum(axis=1)
        docs[left] += linked @ copies[right]
        if cell.column("a")[0] != cell.column("b")[0]:
            links[right] += linked.sum(axis=0)
            docs[right] += copies[left] @ linked
        some = np.flatnonzero(links)
        yield pa.record_batch(
            [pa.array([ids[i] for i in some], pa.binary()), pa.array([ids[order[label[i]]] for i in some], pa.binary()),
             pa.array(links[some]), pa.array(docs[some])],
            names=["set_id", "least", "n_links", "n_docs"],
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 21):
            hashes, n = shingle_sets(_lower(texts(part, "text")), SHINGLE)
            sets = [x.tobytes() for x in np.split(hashes, np.cumsum(n)[:-1])]
            columns = [pa.array(set_ids(hashes, n), pa.binary()), pa.array(sets, pa.binary())]
            yield pa.record_batch(columns, names=["set_id", "shingles"])


def near_duplicates(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links, class_size, text_key, is_first for each row of docs (doc_id, text).

    class_id is the least doc_id of the class; n_links counts other documents at the threshold, copies
    included, n_text_links other sets of shingles. text_key is xxhash64 of the text; is_first marks the text that
    stands for its class (more than one row where rows repeat).
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    described = stored(rows.mapInArrow(partial(_describe, runs(recall), THRESHOLD), SETS), "shingle-sets")
    some = described.filter(F.col("n") > 0)
    pick = F.min_by(F.struct("n", "sketch", "nodes", F.col("text_key").alias("first_key")), F.struct("doc_id", "text_key")).alias("s")
    sets = some.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), pick)
    sets = stored(sets.select("set_id", "first_id", "copies", "s.*"), "distinct-sets")

    found = stored(leaves(sets), "leaves")
    where = found.groupBy("set_id").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    info = sets.select("set_id", "n", "sketch", "copies").join(where, "set_id")
    rows_in = found.join(info, "set_id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows_in = rows_in.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit("block")), "blocks").cast("int"))
    rows_in = rows_in.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_in = rows_in.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    cells = rows_in.select("node", "a", "b", "block", "set_id", "n", "copies", "sketch", "leaves")
    key = ["node", "a", "b"]
    schema = "node long, a int, b int, block int, set_id binary, n int, copies long, leaves array<bigint>"
    near = stored(cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_candidates, schema), "candidates")

    wanted = near.select("set_id").distinct().join(sets.select("set_id", "first_id", "first_key"), "set_id")
    wanted = wanted.select("first_id", "first_key").hint("shuffle_hash")
    whole = rows.join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key")), "left_semi").select("text")
    whole = whole.mapInArrow(_shingles, "set_id binary, shingles binary").dropDuplicates(["set_id"])
    both = near.join(whole, "set_id").select(*key, "block", "set_id", "copies", "leaves", "shingles")
    links = stored(both.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify, LINKS), "links")

    labels = components(links.select(F.col("set_id").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("n_links").alias("n_text_links"), F.sum("n_docs").alias("n_docs"))
    labelled = sets.select("set_id", "first_id", "first_key", "copies").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "set_id"))
    first = F.min(F.struct("first_id", "first_key"))
    classes = labelled.groupBy("label").agg(first.alias("f"), F.sum("copies").alias("class_size"))
    classes = classes.select("label", F.col("f.first_id").alias("class_id"), F.col("f.first_key").alias("class_key"), "class_size")
    per_set = labelled.join(classes, "label").join(counts, "set_id", "left").select(
        F.col("set_id").alias("_s"), "class_id", "class_key", "class_size", F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    same = (F.col("set_id") == F.col("_s")) & (F.col("n") > 0)
    out = described.select("doc_id", "text_key", "set_id", "n").join(per_set, same, "left")
    is_first = (F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    none = lambda c: F.when(c > NO_ID, c)
    return out.select(
        none(F.col("doc_id")).alias("doc_id"),
        none(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "text_key",
        F.coalesce(is_first, F.lit(True)).alias("is_first"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "is_first")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class stays, and all rows without words."""
    d, t, n = (unused(docs, x) for x in ("first_doc", "first_text", "row"))
    found = near_duplicates(docs).filter("is_first").select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t))
    kept = docs.filter(worded).join(found.hint("shuffle_hash"), same, "left_semi")
    # Rows that repeat: each task leaves one of them before they meet.
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and kind in _PLAIN]
    along = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*others, F.lit(0))
    once = kept.withColumn(n, F.row_number().over(along)).filter(F.col(n) == 1).drop(n)
    return once.unionByName(docs.filter(~worded))
