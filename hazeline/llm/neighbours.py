"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The top of the tree is fitted on FIT_ROWS rows at most, the first in the order of a hash of vec_id, so it can be sent to
every task. Every row is then filed under its leaf. A leaf with over GROW_ROWS rows is split by a tree of its own, fitted in
one task on about FIT_ROWS of its rows, up to LEVELS levels: leaves stay small however large the table, and no more
of the tree than one node's part is ever in one place.

A query walks the tree level by level: through a priority queue that always opens the closest unopened branch it orders the
leaves of a node, and keeps the closest ones over all its nodes. How many it keeps is calibrated at each level: for
CALIBRATION queries the true neighbours are found by brute force over all rows, and the visits widen until RECALL of them
are covered. A query whose leaves hold too few candidates widens further until it has k.

Leaves of any size are searched: a leaf is cut into parts of about PART_ROWS rows, its queries into parts of
QUERY_ROWS, and each part of queries meets each part of rows in a task, so identical vectors don't gather in one.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither
do those whose length isn't the commonest among the vectors (distances between lengths aren't defined; queries of another
length have no result); rows with null vec_id take no part;
distance ties go to the smaller vec_id; a repeated vec_id is several rows; fewer than k candidates give all of them; an
empty table gives an empty result; extra columns don't matter, whatever their names. Distances are Euclidean in double
precision on the stored vectors.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import stored, table

K, QUERY_STEP = 10, 100
FIT_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 150
GROW_ROWS, LEVELS = 3_000, 4
CALIBRATION, RECALL = 100, 0.95
PART_ROWS, QUERY_ROWS = 2_000, 2_000
#: Rows of a part beyond k that are compared exactly for each query.
SLACK = 16


class Tree:
    """Nodes in arrays: centres; children of a node are first..first+count-1 (count 0: a leaf, numbered in leaf)."""

    def __init__(self, rows: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = [rows.mean(axis=0)]
        self.first, self.count = [0], [0]
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            if len(members) <= leaf_rows:
                continue
            groups = self._split(rows, members, branches, rng)
            if len(groups) < 2:  # equal vectors can't be told apart
                continue
            self.first[node], self.count[node] = len(self.centres), len(groups)
            for g in groups:
                todo.append((len(self.centres), g))
                self.centres.append(rows[g].mean(axis=0))
                self.first.append(0)
                self.count.append(0)
        self.centres, self.first, self.count = np.array(self.centres), np.array(self.first), np.array(self.count)
        self.leaf = np.cumsum(self.count == 0) - 1
        self.n_leaves = int((self.count == 0).sum())

    @staticmethod
    def _split(rows: np.ndarray, members: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
        x = rows[members]
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(8):
            near = _distances(x, centres).argmin(axis=1)
            centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        near = _distances(x, centres).argmin(axis=1)
        return [members[near == j] for j in range(len(centres)) if (near == j).any()]

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row falls in, by the closest centre at every node."""
        at = np.zeros(len(rows), np.int64)
        while (self.count[at] > 0).any():
            for node in np.unique(at[self.count[at] > 0]):
                mine = np.flatnonzero(at == node)
                few = slice(self.first[node], self.first[node] + self.count[node])
                at[mine] = self.first[node] + _distances(rows[mine], self.centres[few]).argmin(axis=1)
        return self.leaf[at]

    def best_bin_first(self, row: np.ndarray) -> Iterator[tuple[int, float]]:
        """All leaves with their squared distance, the closest unopened branch first."""
        queue = [(0.0, 0)]
        while queue:
            distance, node = heapq.heappop(queue)
            if not self.count[node]:
                yield int(self.leaf[node]), distance
                continue
            few = slice(self.first[node], self.first[node] + self.count[node])
            for j, d in enumerate(_distances(row[None], self.centres[few])[0].tolist()):
                heapq.heappush(queue, (d, int(self.first[node] + j)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, for choosing only."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (doubles) of the rows that take part, of whatever length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def commonest_length(vectors: DataFrame) -> int:
    """The length of most vectors, the smaller on ties; 0 without vectors."""
    sizes = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


ROWS = "vec_id long, embedding array<double>, node string"


def _file_rows(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = tree.leaf_of(_matrix(batch.column("embedding")))
        yield batch.append_column("node", pa.array(leaf.astype(str).tolist(), pa.string()))


def _fit_node(rows: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(np.stack(rows["embedding"].to_numpy()))
    return pd.DataFrame({"node": [rows["node"].iloc[0]], "tree": [pickle.dumps(tree)], "n_leaves": [tree.n_leaves]})


def _file_below(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return rows[["vec_id", "embedding", "node"]]
    leaf = pickle.loads(trees["tree"].iloc[0]).leaf_of(np.stack(rows["embedding"].to_numpy()))
    return pd.DataFrame({"vec_id": rows["vec_id"], "embedding": rows["embedding"], "node": rows["node"] + "/" + pd.Series(leaf.astype(str), rows.index)})


def grown(filed: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """filed with the rows of its large nodes filed under nodes below them, and the trees of these (node, tree); None where no
    node is large or can be split."""
    sizes = filed.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > GROW_ROWS)
    rank = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = filed.join(sizes, "node").filter(rank < FIT_ROWS / F.col("n")).select("node", "embedding")
    trees = stored(chosen.groupBy("node").applyInPandas(_fit_node, "node string, tree binary, n_leaves int"), "trees").filter("n_leaves > 1")
    if not trees.limit(1).count():
        return None
    parts = trees.join(sizes, "node").select("node", "tree", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    dealt = filed.join(parts.select("node", "parts"), "node").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    copies = parts.select("node", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    below = dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInPandas(_file_below, ROWS)
    rest = filed.join(parts.select("node"), "node", "left_anti").select("vec_id", "embedding", "node")
    return stored(rest.union(below), "filed-vectors"), trees.select("node", "tree")


def _top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """For each query its k nearest of rows, its own id left out; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")  # equal distances then come in the order of ids
    rows, ids = rows[order], ids[order]
    few = min(k + SLACK, len(ids))
    norms = (rows * rows).sum(axis=1)
    out = []
    for start in range(0, len(queries), 256):
        q, qi = queries[start : start + 256], query_ids[start : start + 256]
        squares = (q * q).sum(axis=1)
        rough = squares[:, None] - 2 * (q @ rows.T) + norms[None]
        rough[qi[:, None] == ids[None]] = np.inf
        # The rough order picks some more than k, which are compared exactly.
        near = np.sort(np.argpartition(rough, few - 1, axis=1)[:, :few], axis=1)
        picked = np.take_along_axis(rough, near, axis=1)
        exact = np.sqrt(((rows[near] - q[:, None]) ** 2).sum(axis=2))
        exact[~np.isfinite(picked)] = np.inf
        best = np.argsort(exact, axis=1, kind="stable")[:, :k]
        found, score = np.take_along_axis(near, best, axis=1), np.take_along_axis(exact, best, axis=1)
        # Rows within rounding of the k-th may have been left out: such queries are done over all their rows.
        edge = np.partition(picked, min(k, few) - 1, axis=1)[:, min(k, few) - 1] + 1e-9 * (squares + norms.max(initial=0.0))
        unsure = np.flatnonzero((picked.max(axis=1) <= edge) & (few < len(ids)))
        for i in unsure.tolist():
            d = np.where(qi[i] == ids, np.inf, np.sqrt(((rows - q[i]) ** 2).sum(axis=1)))
            found[i] = np.argsort(d, kind="stable")[: found.shape[1]]
            score[i] = d[found[i]]
        real = np.isfinite(score)
        out.append(pd.DataFrame({"query_id": np.repeat(qi, real.sum(axis=1)), "vec_id": ids[found[real]], "score": score[real]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


FOUND = "query_id long, vec_id long, score double"


def _brute(queries: np.ndarray, query_ids: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = _top(queries, query_ids, _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), k)
            yield pa.RecordBatch.from_pandas(found.astype({"query_id": "int64", "vec_id": "int64"}), preserve_index=False)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


OPENED = "query_id long, node string, d double"


def _open_top(tree: Tree, visits: int, sizes: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first leaves of each query's walk: visits of them, and more until they hold over k rows."""
    for batch in batches:
        query, node, distance = [], [], []
        for i, row in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding")), strict=True):
            have = 0
            for n, (leaf, d) in enumerate(tree.best_bin_first(row)):
                if n >= visits and have > k:  # its own row may be among them
                    break
                have += sizes[leaf]
                if sizes[leaf]:
                    query.append(i)
                    node.append(str(leaf))
                    distance.append(d)
        yield pa.record_batch([pa.array(query, pa.int64()), pa.array(node, pa.string()), pa.array(distance, pa.float64())], names=["query_id", "node", "d"])


def _open_node(visits: int, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    query, node, distance = [], [], []
    if len(queries):
        tree = pickle.loads(trees["tree"].iloc[0])
        for i, at, row in zip(queries["query_id"], queries["node"], queries["embedding"], strict=True):
            for leaf, d in islice(tree.best_bin_first(np.asarray(row)), visits):
                query.append(i)
                node.append(f"{at}/{leaf}")
                distance.append(d)
    return pd.DataFrame({"query_id": np.array(query, np.int64), "node": np.array(node, object), "d": np.array(distance, float)})


def opened_below(opened: DataFrame, queries: DataFrame, trees: DataFrame, visits: int) -> DataFrame:
    """query_id, node, d, place: the nodes that queries opened, with those that have a tree replaced by its first leaves, in the
    order of their distance; visits of them for each query."""
    inner = opened.join(trees.select("node"), "node", "left_semi").join(queries.withColumnRenamed("vec_id", "query_id"), "query_id")
    # A copy of a tree for each QUERY_ROWS of its queries; trees that no query opens aren't copied.
    parts = inner.groupBy("node").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    inner = inner.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit("part")), "parts").cast("int"))
    copies = trees.join(parts, "node").select("node", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    below = inner.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInPandas(partial(_open_node, visits), OPENED)
    both = opened.join(trees.select("node"), "node", "left_anti").select("query_id", "node", "d").union(below)
    along = Window.partitionBy("query_id").orderBy("d", "node")  # a query's own nodes: its visits times a node's leaves at most
    return both.withColumn("place", F.row_number().over(along)).filter(F.col("place") <= visits)


def _covering(places: list[int], recall: float) -> int:
    return int(np.quantile(places, recall, method="higher")) if places else 1


class Index:
    """A tree over filed rows (vec_id, embedding, node) and the visits of each of its levels."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, sample: list[list[float]], k: int, recall: float):
        self.k = k
        self.top = Tree(np.array(sample, float))
        filed = [stored(vectors.mapInArrow(partial(_file_rows, self.top), ROWS), "filed-vectors")]
        self.trees: list[DataFrame] = []
        while len(filed) < LEVELS and (below := grown(filed[-1])):
            filed.append(below[0])
            self.trees.append(below[1])
        self.filed = filed[-1]
        self.sizes = np.zeros(self.top.n_leaves, np.int64)
        for r in filed[0].groupBy("node").count().collect():  # a row a leaf of the top; their number is bounded by the sample
            self.sizes[int(r["node"])] = r["count"]
        self.visits: list[int] = []
        self._calibrate(filed, queries, recall)

    def _calibrate(self, filed: list[DataFrame], queries: DataFrame, recall: float) -> None:
        """The visits of each level that cover recall (shared by the levels) of the true neighbours of CALIBRATION queries."""
        few = queries.orderBy(F.xxhash64("vec_id", F.lit("calibration")), "vec_id").limit(CALIBRATION)
        rows = few.collect()
        if not rows:
            self.visits = [1] * len(filed)
            return
        each = recall ** (1 / len(filed))
        x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows], np.int64)
        truth = stored(_best(filed[0].mapInArrow(partial(_brute, x, ids, self.k), FOUND), self.k), "true-neighbours")
        near = truth.select("query_id", "vec_id").hint("broadcast")  # CALIBRATION * k rows
        held = filed[0].join(near, "vec_id").select("query_id", "node").collect()
        place = {(int(i), str(leaf)): n for i, row in zip(ids, x, strict=True) for n, (leaf, _) in enumerate(self.top.best_bin_first(row), 1)}
        self.visits = [_covering([place[r["query_id"], r["node"]] for r in held], each)]
        for level, rows_below in enumerate(filed[1:]):
            opened = opened_below(self.opened(few, level), few, self.trees[level], 1 << 30)
            found = rows_below.join(near, "vec_id").select("query_id", "node").join(opened, ["query_id", "node"]).select("place").collect()
            self.visits.append(max(_covering([r["place"] for r in found], each), self.k + 1))

    def opened(self, queries: DataFrame, levels: int | None = None) -> DataFrame:
        """query_id, node, d: what each query opens at the last level, or below so many levels."""
        out = queries.mapInArrow(partial(_open_top, self.top, self.visits[0], self.sizes, self.k), OPENED)
        for trees, visits in list(zip(self.trees, self.visits[1:], strict=False))[:levels]:
            # Stored, as the queries of each node are counted before they are dealt.
            out = opened_below(stored(out, "opened-above"), queries, trees, visits).drop("place")
        return out


def _search(k: int, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    a, b = np.stack(queries["embedding"].to_numpy()), np.stack(rows["embedding"].to_numpy())
    return _top(a, queries["query_id"].to_numpy(), b, rows["vec_id"].to_numpy(), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors found for each of queries (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries)
    same = F.size("embedding") == commonest_length(vectors)
    vectors, queries = vectors.filter(same), queries.filter(same)
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit("tree")), "vec_id").limit(FIT_ROWS).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(vectors, queries, [r["embedding"] for r in sample], k, recall)
    opened = stored(index.opened(queries).select("query_id", "node"), "opened-nodes")

    # Each part of a node's queries meets each part of its rows.
    parts = lambda df, most, name: df.groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = stored(parts(index.filed, PART_ROWS, "n_rows").join(parts(opened, QUERY_ROWS, "n_queries"), "node"), "blocks")
    of = lambda key, n: F.pmod(F.xxhash64(key, F.lit("part")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = opened.join(queries.withColumnRenamed("vec_id", "query_id"), "query_id").join(blocks, "node")
    asked = asked.select("node", "query_id", "embedding", of("query_id", "n_queries").alias("b"), every("n_rows").alias("a"))
    dealt = index.filed.join(blocks, "node").select("node", "vec_id", "embedding", of("vec_id", "n_rows").alias("a"), every("n_queries").alias("b"))
    key = ["node", "a", "b"]
    near = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(partial(_search, k), FOUND)
    return _best(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))
