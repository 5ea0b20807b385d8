"""The Merkle manifest against hashlib."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hazeline.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, number int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest(*[field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, t)])
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id, leaf(r, r.text), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [levels([x[1] for x in by[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    root, out = top[-1][0] if rows else None, []
    for p, s in enumerate(sources):
        for k, (doc_id, own, r) in enumerate(by[s]):
            touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            up = leaf(r, r.text and r.text.replace("\n", "")) if touched else own
            proof = []
            for tree, at in ((trees[p], k), (top, p)):
                for level in tree[:-1]:
                    first = at // 3 * 3
                    run = level[first : first + 3]
                    proof += run[: at - first] + run[at - first + 1 :]
                    run[at - first] = up
                    up, at = digest(*run), at // 3
            out.append((doc_id, own, trees[p][-1][0], root, digest(*proof), up, up == root))
    return sorted(map(repr, out))


def proven(spark, docs, tmp_path):
    """What the query does, over any documents."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(repr(tuple(r)) for r in rows)


def test_manifest_equals_hashlib_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(repr(tuple(r)) for r in manifest.op12_merkle_manifest(spark, sf).collect())
    assert got == brute(spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.mark.parametrize("span", [3**6, 3])
def test_manifest_of_odd_rows(spark, tmp_path, monkeypatch, span):
    """Nulls, empty and very long texts, repeats, shared ids, clashing columns; also with packs of one level."""
    monkeypatch.setattr(manifest, "SPAN", span)
    monkeypatch.setattr(manifest, "LEVELS", {729: 6, 3: 1}[span])
    rows = [(i, "a", "en", i, f"line {i}\nline", "x", 1, 1) for i in range(30)]
    rows += [(7, "a", "en", 7, "another text", "x", 1, 1), (7, "a", "en", 7, "another text", "x", 1, 1)]
    rows += [(None, "a", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (40, None, "de", 1, "", "x", 1, 1)]
    rows += [(41, "lone", "fr", 9, "é\n" * 200_000, "x", 1, 1), (42, "", "fr", 9, "\n", "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert proven(spark, docs, tmp_path) == brute(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_manifest_of_few_rows(spark, tmp_path, n):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t", "x", 1, 1) for i in range(n)], SCHEMA)
    assert proven(spark, docs, tmp_path) == brute(docs.collect())


def test_some_leaves_are_proven_alone(spark, tmp_path):
    """Requests for a few leaves give the paths that all leaves' requests give."""
    leaves = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    folder = f"{tmp_path}/m"
    manifest.write_manifest(leaves, folder)
    asked = spark.read.parquet(f"{folder}/leaves").select("tree", "number", "leaf")
    every = {(r.tree, r.number): r for r in manifest.proofs(spark, folder, asked).collect()}
    some = manifest.proofs(spark, folder, asked.filter("number in (0, 250, 499)")).collect()
    assert len(every) == 2000
    assert len(some) == 12
    assert all(every[r.tree, r.number] == r and r.digest == r.leaf for r in some)
    whole = manifest.proofs(spark, folder, asked).select("root", manifest.folded(F.col("leaf"), F.col("path")).alias("folded"))
    assert whole.filter("root <> folded").count() == 0
