"""Merkle manifest of a dataset: a content-addressed DAG, descended from the root to prove leaves.

A leaf is the digest of a row's fields. In each source's tree, and then over the sources' roots, runs of
ARITY consecutive nodes become their digest until one node remains. The manifest stores digest-to-children
records, packed by subtrees of LEVELS levels (a row holds ARITY**LEVELS nodes of one level at most):

    folder/leaves    source, doc_id, leaf, further columns, tree (the source's place), number (the leaf's rank in its source)
    folder/trees     source, tree, size, subroot
    folder/packs     kind (source or top), round (0 at the leaves), tree, pack, root, levels, records

Requests for leaves descend from the root: each level's digit of the rank picks a child, and the children that
it leaves are collected as the path's segment. A segment is "<digit><digests of the others, left to right>"; paths
reversed, from the leaf up, are the proof. All requests of a pack descend in one row, so a level isn't a shuffle.

Defined cases: a null field is "-", an empty text "0:"; of equal doc_ids the lesser leaf is first, a null doc_id before
others (and never tampered with); rows that repeat are leaves of their own; a null source is a source, the first; a lone
leaf or source has an empty segment list, so that root, subroot and leaf may be equal; an empty table has no root and no
rows; very long texts are hashed whole; columns beyond FIELDS don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hazeline.functions.ranks import numbered
from hazeline.llm.common import shared_dir, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 3, 6
SPAN = ARITY**LEVELS
PACKS = "kind string, round int, tree long, pack long, root string, levels int, records array<struct<digest:string,children:array<string>>>"


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _depth(size: Column) -> Column:
    """The levels over size nodes: the powers of ARITY below size."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(39)]), lambda p: p < size))


def _rounds(size: Column) -> Column:
    """The packs that a path through size nodes crosses, one at least."""
    return F.greatest(F.ceil(_depth(size) / LEVELS), F.lit(1)).cast("int")


def _digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def records_of(nodes: list[str], levels: int) -> tuple[str, list[dict]]:
    """The root over nodes after so many levels and its records, each digest once."""
    found = {}
    for _ in range(levels):
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        nodes = [_digest(r) for r in runs]
        found.update(zip(nodes, runs, strict=True))
    (root,) = nodes
    return root, [{"digest": d, "children": c} for d, c in found.items()]


def _pack(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            root, records = records_of([x["digest"] for x in row.pop("nodes")], row["levels"])
            yield pa.RecordBatch.from_pylist([row | {"root": root, "records": records}], schema=schema)


def _build(nodes: DataFrame, kind: str, rounds: int, folder: str) -> DataFrame:
    """Writes the packs over nodes (tree, number, size, digest), round after round; tree, digest of the roots."""
    spark = nodes.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(PACKS))
    roots = None
    for k in range(rounds):
        pack = F.expr(f"number div {SPAN}")
        levels = F.least(F.lit(LEVELS), _depth(F.first("size"))).cast("int")
        in_order = F.array_sort(F.collect_list(F.struct("number", "digest")))
        rows = nodes.groupBy("tree", pack.alias("pack")).agg(in_order.alias("nodes"), levels.alias("levels"))
        rows = rows.withColumns({"kind": F.lit(kind), "round": F.lit(k)})
        path = f"{folder}/packs/{kind}-{k}"
        rows.mapInArrow(partial(_pack, schema), PACKS).write.parquet(path)
        made = spark.read.schema(PACKS).parquet(path)
        sizes = nodes.select("tree", "size").distinct() if k == 0 else nodes.groupBy("tree").agg(F.first("size").alias("size"))
        above = made.select("tree", F.col("pack").alias("number"), F.col("root").alias("digest")).join(sizes, "tree")
        above = above.withColumn("size", F.ceil(F.col("size") / SPAN).cast("long"))
        done = above.filter("size = 1").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        nodes = above.filter("size > 1")
    return roots


def write_manifest(leaves: DataFrame, folder: str) -> None:
    """Writes the manifest of leaves (source, doc_id, leaf and any further columns)."""
    spark = leaves.sparkSession
    ranked = numbered(leaves, ["source"], ["doc_id", "leaf"], "number", lambda df: stored(df, "leaf-ranges"))
    ranked = stored(ranked, "ranked-leaves")
    sizes = ranked.groupBy("source").agg(F.count("*").alias("size"))
    trees = stored(numbered(sizes, [], ["source"], "tree", lambda df: stored(df, "source-ranges")), "sources")
    known = trees.select(F.col("source").alias("_source"), "tree", "size")
    placed = ranked.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed.drop("size").write.parquet(f"{folder}/leaves")
    bounds = trees.agg(F.max(_rounds(F.col("size"))).alias("within"), _rounds(F.count("*")).alias("over")).first()
    nodes = placed.select("tree", "number", "size", F.col("leaf").alias("digest"))
    roots = _build(nodes, "source", bounds["within"] or 1, folder)
    trees.join(roots.withColumnRenamed("digest", "subroot"), "tree").write.parquet(f"{folder}/trees")
    subroots = spark.read.parquet(f"{folder}/trees")
    n_trees = trees.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("number"), F.lit(n_trees).cast("long").alias("size"), F.col("subroot").alias("digest"))
    _build(top, "top", bounds["over"], folder)


def _walk(root: str, records: dict[str, list[str]], levels: int, place: int) -> tuple[str, list[str]]:
    """The node at a place of the pack and the segments on the way down."""
    node, segments = root, []
    for k in reversed(range(levels)):
        digit = place // ARITY**k % ARITY
        children = records[node]
        segments.append(f"{digit}{''.join(children[:digit])}{''.join(children[digit + 1 :])}")
        node = children[digit]
    return node, segments


def _descend(schema: pa.Schema, span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs with the path to their root and the places asked for, to these places."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            records = {r["digest"]: r["children"] for r in row["records"]}
            out = []
            for asked in row["asked"]:
                node, segments = _walk(row["digest"], records, row["levels"], asked["place"])
                number = row["pack"] * span + asked["place"]
                out.append({"tree": row["tree"], "number": number, "digest": node, "path": row["path"] + segments, "subroot": row["subroot"] or node, **asked})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _descent(packs: DataFrame, start: DataFrame, requests: DataFrame) -> DataFrame:
    """tree, number, digest, path and subroot of each request (tree, number, any further columns), from start (tree, size,
    digest, path, subroot), the roots. Where start has no subroot it is the node found."""
    extra = [c for c in requests.columns if c not in ("tree", "number")]
    start = start.withColumn("rounds", _rounds(F.col("size")))
    most = start.agg(F.max("rounds")).first()[0] or 0
    frontier = None
    for k in reversed(range(most)):
        entering = start.filter(F.col("rounds") == k + 1).select("tree", F.lit(0).cast("long").alias("pack"), "digest", "path", "subroot")
        here = entering if frontier is None else entering.unionByName(frontier.withColumnRenamed("number", "pack"))
        number = F.expr(f"number div {SPAN**k}")
        columns = extra if k == 0 else []
        asked = requests.select("tree", number.alias("number"), *columns)
        asked = asked if k == 0 else asked.distinct()
        place = F.struct(F.expr(f"cast(number % {SPAN} as int)").alias("place"), *columns)
        asked = asked.groupBy("tree", F.expr(f"number div {SPAN}").alias("pack")).agg(F.collect_list(place).alias("asked"))
        at = packs.filter(F.col("round") == k).dropDuplicates(["root"]).select(F.col("root").alias("digest"), "levels", "records")
        rows = here.join(asked, ["tree", "pack"]).join(at, "digest")
        kinds = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes if c in columns)
        out = "tree long, number long, digest string, path array<string>, subroot string" + (f", {kinds}" if kinds else "")
        frontier = rows.mapInArrow(partial(_descend, to_arrow_schema(StructType.fromDDL(out)), SPAN), out)
        if k:
            frontier = stored(frontier, "frontier")
    return frontier


def proofs(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """tree, number, digest, path, subroot, root and the further columns of requests (tree, number, ...; each leaf once)."""
    packs = spark.read.schema(PACKS).option("recursiveFileLookup", True).parquet(f"{folder}/packs")
    trees = spark.read.parquet(f"{folder}/trees")
    top = packs.filter("kind = 'top'")
    highest = top.orderBy(F.desc("round")).select("root").first()  # one row: the manifest's root
    root = F.lit(highest["root"] if highest else None).cast("string")
    none = F.lit(None).cast("string")
    start = trees.agg(F.count("*").alias("size")).filter("size > 0").select(F.lit(0).cast("long").alias("tree"), "size", root.alias("digest"), F.array().cast("array<string>").alias("path"), none.alias("subroot"))
    wanted = requests.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("number")).distinct()
    found = _descent(top, start, wanted)
    if found is None:
        return requests.select("tree", "number", *[none.alias(c) for c in ("digest", "subroot", "root")], F.array().cast("array<string>").alias("path"), *[c for c in requests.columns if c not in ("tree", "number")])
    subtrees = found.select(F.col("number").alias("tree"), "digest", "path", F.col("digest").alias("subroot"))
    subtrees = stored(subtrees.join(trees.select("tree", "size"), "tree"), "subtrees")
    return _descent(packs.filter("kind = 'source'"), subtrees, requests).withColumn("root", root)


def _others(segment: Column) -> Column:
    return F.substring(segment, 2, 1 << 20)


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), _others), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that leaf and its path give."""

    def step(node: Column, segment: Column) -> Column:
        left = 64 * F.substring(segment, 1, 1).cast("int")
        others = _others(segment)
        return F.sha2(F.concat(others.substr(F.lit(1), left), node, others.substr(left + 1, F.lit(1 << 20))), 256)

    return F.aggregate(F.reverse(path), leaf, step)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(touched, leaf_digest(text=F.translate("text", "\n", ""))).otherwise(F.col("leaf"))
    leaves = stored(docs.withColumn("leaf", leaf_digest()).withColumn("tampered", tampered).select("source", "doc_id", "leaf", "tampered"), "leaf-digests")
    folder = shared_dir(spark, "manifest")
    write_manifest(leaves, folder)
    requests = spark.read.parquet(f"{folder}/leaves").select("tree", "number", "doc_id", "leaf", "tampered")
    found = proofs(spark, folder, requests)
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end))"""


def _sql_leaf(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"


SQL = {
    "op12_merkle_manifest": f"""with recursive d as (
  select doc_id, source, {_sql_leaf("text")} as leaf, {_sql_leaf("replace(text, chr(10), '')")} as changed,
    coalesce((4294967295 - {_CRC}) % 2 = 0, false) as touched from documents),
f as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as k,
    dense_rank() over (order by source nulls first) - 1 as tree from d),
nodes as (select tree, 0 as level, k, leaf as node from f
  union all
  select tree, level + 1, k // 3, sha256(string_agg(node, '' order by k)) from
    (select *, count(*) over (partition by tree) as n from nodes) where n > 1 group by tree, level, k // 3),
sub as (select tree, level as height, node from (select *, row_number() over (partition by tree order by level desc) as r from nodes) where r = 1),
tops as (select 0 as level, tree as k, node from sub
  union all
  select level + 1, k // 3, sha256(string_agg(node, '' order by k)) from
    (select *, count(*) over () as n from tops) where n > 1 group by level, k // 3),
root as (select level as height, node from tops order by level desc limit 1),
steps as (select n.tree, n.level, n.k, n.node from nodes n join sub s on s.tree = n.tree and n.level < s.height union all select s.tree, s.height + t.level, t.k, t.node from sub s, tops t),
climb as (select f.doc_id, f.leaf, f.tree, f.k as rank, 0 as at, f.k, '' as proof, case when touched then changed else leaf end as up from f
  union all
  select c.doc_id, c.leaf, c.tree, c.rank, c.at + 1, case when c.at + 1 = s.height then c.tree else c.k // 3 end,
    c.proof || coalesce((select string_agg(x.node, '' order by x.k) from steps x where x.tree = c.tree and x.level = c.at and x.k // 3 = q // 3 and x.k <> q), ''),
    sha256(coalesce((select string_agg(case when x.k = q then c.up else x.node end, '' order by x.k) from steps x where x.tree = c.tree and x.level = c.at and x.k // 3 = q // 3), ''))
  from (select *, k as q from climb) c join sub s on s.tree = c.tree, root r where c.at < s.height + r.height)
select doc_id, leaf, s.node as subroot, r.node as root, sha256(proof) as proof_sha256, up as folded_root, up = r.node as verified
from climb c join sub s on s.tree = c.tree, root r where c.at = s.height + r.height""",
}
