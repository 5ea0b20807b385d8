"""Token counts through a digest cache.

Texts are keyed by the digest of their content and the digest of the tokenizer's version. Counts that the
cache holds are joined; only the distinct texts that it lacks are encoded, and their counts are appended.

Content is normalised to the text itself with null as empty: anything stronger would change counts.
Defined cases: null and empty text have 0 tokens; repeated texts are encoded once and each row gets its
count; a null doc_id is a key like others; an empty table gives an empty result. Texts are never cut.
The cache is a Parquet folder; an interrupted append leaves no partial file, so a run can be repeated.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, shared_dir, stored, table, texts
from hazeline.llm.units import TOKENIZER, unit_encoder

LIMIT = 1024
#: Digests that a task remembers.
_SEEN = 200_000
CACHE = "digest binary, version binary, n_tokens long"


@lru_cache(maxsize=4)
def counter(name: str):
    """A function from texts to token counts, by the library of the file's kind."""
    if not name.endswith(".model"):
        return lambda xs: unit_encoder(name).encode(xs)[1].tolist()
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=name if os.sep in name else public_tokenizers.path(name))
    return lambda xs: [len(ids) for ids in sp.encode(xs, num_threads=1)]


def tokenizer_version(name: str) -> bytes:
    """Digest of the file, the library's version and the options."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if name.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(name if os.sep in name else public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|no special tokens added".encode()).digest()


def _encode(name: str, version: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        seen: set[bytes] = set()  # rows equal in id and text come to one task, but for splits of very many
        for batch in batches:
            for part in pieces(batch, "text"):
                new = {d: i for i, d in enumerate(part.column("digest").to_pylist()) if d not in seen}
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(new)
                part = part.take(pa.array(list(new.values()), pa.int64()))
                yield pa.record_batch(
                    [part.column("digest"), pa.array([version] * len(new), pa.binary()), pa.array(count(texts(part, "text")), pa.int64())],
                    names=["digest", "version", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, cache: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text); cache is grown as needed.

    cache: a folder that outlives the session, or None for a new one in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or shared_dir(spark, "token-cache")
    version = tokenizer_version(name)
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    keys = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == F.lit(version)).select("digest", "n_tokens")

    # One row stands for each distinct text; text itself moves once, to the few columns of its row.
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(known, "digest", "left_anti")
    first = first.withColumnRenamed("digest", "first_digest").hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    misses = whole.join(first, same, "left_semi").select("digest", "text")
    fresh = misses.mapInArrow(_encode(name, version), CACHE)
    fresh = fresh.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens"))  # of split tasks
    fresh.write.mode("append").parquet(cache)

    # A folder that two runs grew at once can hold a digest twice; the counts are the same.
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == F.lit(version))
    # Stored, as Spark splits a text with very many copies only where both sides of a join are plain shuffles.
    counts = stored(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
