"""Near duplicates by SetSketch against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazeline.llm import setsketch
from hazeline.llm.shingles import shingle_sets

SPACE = b" \t\n\x0b\x0c\r"


def shingles(text):
    words = (text or "").encode().lower().translate(bytes.maketrans(SPACE, b" " * 6)).split(b" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    out = [(d, len(s), least.get(root(i)), d == least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(map(repr, out))


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, label string, set_id binary")
    return sorted(repr(tuple(r)) for r in setsketch.near_classes(df).collect())


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        text = rng.choice(words, 60 + 40 * base)
        for copy in range(14):
            t = text.copy()
            for at in rng.integers(0, len(t), copy * len(t) // 100):
                t[at] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows + [(len(rows) + i, " ".join(rng.choice(words, 80))) for i in range(20)]


@pytest.mark.parametrize("block", [2000, 3])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2000, 5])
def test_cells_alone_give_all_classes(spark, monkeypatch, block):
    """One bucket of all sets, none of them its leader, in one or many blocks."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    sets = setsketch._distinct(docs.mapInArrow(setsketch._describe, setsketch.DESCRIBED))
    members = sets.select(F.lit(1).cast("long").alias("key"), F.lit(b"").alias("leader"), "set_id")
    labels = spark.createDataFrame([], "node binary, label binary")
    links = setsketch._links_across(members, labels, sets, docs, 80)
    by_set = {bytes(r.set_id): r.first_id for r in sets.collect()}
    classes = {}
    for r in setsketch._labels(links).collect():
        classes.setdefault(bytes(r.label), []).append(by_set[bytes(r.node)])
    wanted = {}
    for r in brute(rows):
        doc_id, _, component, _ = r.strip("()").split(", ")
        if int(doc_id) in by_set.values():  # copies are one set
            wanted.setdefault(int(component), []).append(int(doc_id))
    assert sorted(map(sorted, classes.values())) == sorted(sorted(x) for x in wanted.values() if len(x) > 1)


def test_a_cell_links_classes_not_rows():
    """Two classes of many rows that are all linked gave a link for each row."""
    rows, shingles_ = 40, list(range(100))
    cell = pa.table({
        "node": pa.array([7] * rows), "a": pa.array([0] * rows, pa.int32()), "b": pa.array([0] * rows, pa.int32()), "block": pa.array([0] * rows, pa.int32()),
        "set_id": pa.array([b"s%02d" % i for i in range(rows)]), "label": pa.array([b"c%d" % (i % 4) for i in range(rows)]),
        "shingles": pa.array([[x + (1000 if i % 4 == 3 else 0) for x in shingles_] for i in range(rows)], pa.list_(pa.int64())),
    })
    links = [tuple(r.values()) for b in setsketch._cell_links(80, iter(cell.to_batches())) for r in b.to_pylist()]
    assert sorted(links) == [(b"c0", b"c1"), (b"c0", b"c2")]


def test_least_follows_chains():
    rng = np.random.default_rng(1)
    order = rng.permutation(300)
    least = setsketch._least(order[:199], order[1:200], 300)
    assert (least[order[:200]] == order[:200].min()).all()
    assert (least[order[200:]] == order[200:]).all()


def test_classes_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(repr(tuple(r)) for r in setsketch.op11_setsketch(spark, sf).collect())
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (5, "one"), (6, "one two"), (7, "É"), (8, "é"), (None, None), (None, "ONE\ttwo")]
    rows += [(None, "alone here"), (None, "alone here"), (20, long), (21, long + " more"), (22, "a b c"), (22, "d e f")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    errors = []
    for shared, more in ((2400, 300), (1500, 1000), (2000, 0), (100, 2000)):
        a, b = x[: shared + more // 3], np.r_[x[:shared], x[shared + more // 3 : shared + more]]
        both = np.union1d(a, b)
        r = setsketch.registers(np.r_[a, b, both], np.array([len(a), len(b), len(both)]))
        assert (setsketch.merged(r[0], r[1]) == r[2]).all()
        n = [np.array([float(len(v))]) for v in (a, b)]
        estimate, _ = setsketch.likelihoods(*n, (r[:1] > r[1:2]).sum(axis=1), (r[:1] < r[1:2]).sum(axis=1), 0.8)
        errors.append(abs(estimate[0] - len(np.intersect1d(a, b)) / len(both)))
    assert max(errors) < 0.15


def test_shingles_fold_ascii_only():
    hashes, n = shingle_sets([b"A b", b"a b", "É b".encode(), b""], 2)
    assert n.tolist() == [1, 1, 1, 0]
    assert hashes[0] != hashes[1]
    assert len({tuple(shingle_sets([x.encode().lower()], 2)[0]) for x in ("A b", "a B", "É b", "é b")}) == 3
