"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this subpackage: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: Java and RE2 pattern of the separators.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is set for this session if it is a local one, as in tests;
    on a cluster that would be another folder on each machine, so it is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="hazeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that this process named, oldest first.
_made: list[str] = []


def n_folders() -> int:
    return len(_made)


def remove_folders(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders named since there were so many (n_folders). DataFrames that read them can't be used afterwards."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _made[since:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _made[since:]


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and return it as read back: later uses don't repeat its work,
    and a lost executor costs no more than the tasks that it ran."""
    path = shared_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(text: Column) -> Column:
    """text without separators at its ends; null as the empty string."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def words(text: Column) -> Column:
    """The words of text as an array; empty for null and for text without a word."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN, -1))


def word_count(text: Column) -> Column:
    """The number of words, without building them."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(SPACE_RUN)) + 1).cast("long")


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with about most_bytes of text at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit integers (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
