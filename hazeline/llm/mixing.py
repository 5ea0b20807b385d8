"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in the order of a digest of their ids and read as one line of words, cut
into blocks of BLOCK_WORDS; the line starts anew when it ends. Slot k of the mix goes to the source in
whose interval of cumulative weights the k-th point of the golden-ratio sequence falls; a source's slots
are ranked, and rank r takes block r of its line, until its target of words is reached to the word.

Everything that grows with the corpus is dealt out by hash: word offsets are sums within ranges of the
digest plus a running sum over ranges, slot ranks are counts within runs of slots plus a running sum over
runs, so a source that holds most rows is never in one task.

Defined cases: null and empty texts have size 0 and are never taken; null is a source of its own, last;
a source without words has target 0; repeated (doc_id, text) rows are separate documents in digest
order (ties in it are broken by doc_id and size; rows equal in all are interchangeable); an empty table
gives empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import stored, table, unused, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2.0
BLOCK_WORDS = 512
#: 2**31 / golden ratio, to the nearest odd integer: k * STEP mod 2**31 has period 2**31 and golden-ratio gaps.
STEP, MODULUS = 1327217885, 1 << 31
RUN, BINS = 4096, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, size): weights repeat over the sources in code-point order.

    Targets share share * all words by weight; none is over epochs * its source's size, and what is cut
    goes to the others by weight. With sources in ascending order of cap a unit of weight, the capped ones
    come first, so the level of the rest is known after each of them. One row a source: the windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(share),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("left")
    # The first source that isn't above its level sets it for all that follow; their own would be lower.
    per = per.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _prefix(df: DataFrame, keys: list[str], bins: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same keys before it, in the order of (bins, order).

    order sorts within a bin. Sums by bin come first; only they are summed up along the line."""
    sums = df.groupBy(*keys, bins).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(bins).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, bins).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bins]], "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bins]]
    joined = local.join(sums, on=same)
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local", *[f"_{k}" for k in [*keys, bins]])


def source_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, size) with word_from: the words of its source before it in digest order."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumn("_digest", digest).withColumn("_bin", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % BINS)
    order = ["_digest", F.asc_nulls_first("doc_id"), "size"]
    return _prefix(docs, ["source"], "_bin", order, F.col("size"), "word_from").drop("_digest", "_bin")


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, epoch, block, words: what each slot of the mix takes, by the golden-ratio sequence.

    The discrepancy of the sequence is at most about log2 of its length; each interval is wider by that
    many slots, so that every source gets the slots that it needs; slots over its target are left out.
    """
    spark = targets.sparkSession
    line = F.col("source_size")
    per = targets.filter(line > 0).withColumns(
        {"n_blocks": F.ceil(line / block), "words_due": F.floor("target").cast("long")}
    )
    # Blocks of the whole rounds and of the last one begun.
    rounds = F.floor(F.col("words_due") / line)
    slots = rounds * F.col("n_blocks") + F.ceil((F.col("words_due") - rounds * line) / block)
    per = per.withColumn("slots", slots.cast("long"))
    total, n = per.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, source string, epoch long, block long, words long")
    spare = 4 * math.ceil(math.log2(total + 2)) + 8
    length = total + n * spare
    to = F.sum(F.col("slots") + spare).over(Window.orderBy(F.asc_nulls_last("source"))) / F.lit(float(length))
    per = per.withColumn("_to", to).withColumn("_from", F.col("_to") - (F.col("slots") + spare) / F.lit(float(length)))
    # An interval is cut at the bins that it meets, so that slots find theirs by an equal key.
    lowest, highest = F.floor(F.col("_from") * BINS), F.least(F.floor(F.col("_to") * BINS), F.lit(BINS - 1))
    cuts = per.withColumn("_bin", F.explode(F.sequence(F.greatest(lowest, F.lit(0)), highest)))
    slot = F.pmod(F.pmod(F.col("slot"), F.lit(MODULUS)) * STEP, F.lit(MODULUS))
    points = spark.range(length).withColumnRenamed("id", "slot").withColumn("_x", slot / F.lit(float(MODULUS)))
    points = points.withColumn("_bin", F.floor(F.col("_x") * BINS))
    inside = (F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to"))
    dealt = points.join(cuts, "_bin").filter(inside).withColumn("_run", F.floor(F.col("slot") / RUN))
    dealt = dealt.select("slot", "source", "source_size", "words_due", "n_blocks", "_run")
    dealt = _prefix(dealt, ["source"], "_run", ["slot"], F.lit(1), "_rank")
    dealt = dealt.withColumns({"epoch": F.floor(F.col("_rank") / F.col("n_blocks")), "block": F.pmod("_rank", "n_blocks")})
    first = F.col("block") * block
    whole = F.least(F.lit(block).cast("long"), line - first)
    due = F.col("words_due") - F.col("epoch") * line - first
    dealt = dealt.withColumn("words", F.least(whole, due)).filter(F.col("words") > 0)
    return dealt.select("slot", "source", "epoch", "block", "words")


def block_parts(lines: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """source, block, doc_id, part_from, part_to: the parts of documents in each block; part_from and part_to
    are word positions in the block, doc_from the document's word at part_from."""
    end = F.col("word_from") + F.col("size")
    spans = F.sequence(F.floor(F.col("word_from") / block), F.floor((end - 1) / block))
    parts = lines.filter(F.col("size") > 0).withColumn("block", F.explode(spans))
    first = F.col("block") * block
    return parts.select(
        "source", "block", "doc_id", "size",
        (F.greatest("word_from", first) - first).alias("part_from"),
        (F.least(end, first + block) - first).alias("part_to"),
        (F.greatest("word_from", first) - F.col("word_from")).alias("doc_from"),
    )


def mix(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """slot, source, epoch, doc_id, size, doc_from, taken: the mix, a row a document part."""
    slots = slots.select("slot", F.col("source").alias("of"), "epoch", F.col("block").alias("at"), "words")
    joined = parts.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    taken = F.least("part_to", "words") - F.col("part_from")
    joined = joined.withColumn("taken", taken).filter(F.col("taken") > 0)
    return joined.select("slot", "source", "epoch", "doc_id", "size", "doc_from", "taken")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of docs (doc_id, source, text), the targets of its sources, and the mix."""
    rows = stored(sized(docs), "mix-sizes")
    targets = stored(source_targets(rows), "mix-targets")
    lines = stored(source_lines(rows), "mix-lines")
    return rows, targets, mix(schedule(targets), block_parts(lines))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    rows, targets, parts = mixed(docs)
    used = parts.groupBy("source", "doc_id", "size").agg(F.sum("taken").alias("taken"))
    # Rows that agree in source, doc_id and size share what they took.
    rows = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    used = used.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_z"), "taken")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z"))
    out = rows.join(used, same, "left").drop("_s", "_d", "_z")
    targets = targets.withColumnRenamed("source", "_t")
    out = out.join(targets, F.col("source").eqNullSafe(F.col("_t")))
    # The first of n equal rows takes the words that don't divide.
    each = F.posexplode(F.sequence(F.lit(1), F.col("n")))
    out = out.withColumn("taken", F.coalesce("taken", F.lit(0))).select("*", each.alias("k", "_i"))
    share = F.floor(F.col("taken") / F.col("n")) + F.when(F.col("k") < F.pmod("taken", "n"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents")).drop("source")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, rounded up to whole documents, in the order
    of the mix: a document stands at the slot that first takes it in each round of its source."""
    _, _, parts = mixed(docs)
    places = parts.groupBy("source", "doc_id", "size", "epoch").agg(F.min("slot").alias("slot"))
    s, d, z, at, size = (unused(docs, x) for x in ("of_source", "of_doc", "of_size", "slot", "size"))
    places = places.select(F.col("source").alias(s), F.col("doc_id").alias(d), F.col("size").alias(z), F.col("slot").alias(at))
    rows = docs.withColumn(size, word_count(F.col("text")))
    same = docs["doc_id"].eqNullSafe(F.col(d)) & docs["source"].eqNullSafe(F.col(s)) & (F.col(size) == F.col(z))
    placed = rows.join(places.hint("shuffle_hash"), same).select(*[docs[c] for c in docs.columns], at)
    return placed.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").drop(at)


SQL = {
    "op6_mix_sources": r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), ranked as (
  select *, (row_number() over (order by source asc nulls last) - 1) % 3 as k, source_size * 2.0e0 as cap from per
), weighted as (
  select *, case k when 0 then 3.0e0 when 1 then 1.0e0 else 2.0e0 end as weight from ranked
), running as (
  select *, cast(sum(source_size) over () as double) * 1.5e0 as total,
    coalesce(sum(cap) over before, 0.0e0) as capped,
    sum(weight) over () - coalesce(sum(weight) over before, 0.0e0) as rest
  from weighted
  window before as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)
), levels as (
  select *, max(case when (total - capped) / rest * weight <= cap then (total - capped) / rest end) over () as level from running
), targets as (
  select source, source_size, least(cap, coalesce(level * weight, cap)) as target from levels
), lined as (
  select d.*, coalesce(sum(size) over (
    partition by source order by ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::UBIGINT % 4096,
      md5(coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size
    rows between unbounded preceding and 1 preceding), 0) as word_from
  from d
), due as (
  select l.doc_id, l.size, t.source_size, t.target, l.word_from, cast(floor(t.target) as bigint) as words
  from lined l join targets t on l.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0 else
    size * (words // source_size) + greatest(0, least(size, words % source_size - word_from)) end as bigint) as taken
from due
"""
}
