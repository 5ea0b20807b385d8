"""Writing samples, configurations and paired predictions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.checks import described


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local session, which has no
    other machines, may do without the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="hazeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Paths that this process named and hasn't removed, oldest first.
_made: list[str] = []


def remove_stored(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was written to the shared folder after the first since paths; DataFrames that read it can't be used
    afterwards."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _made[since:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _made[since:]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back, for small tables that cost much and are read several times."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_split_dataset(samples: DataFrame, path: str, time: str = "valid_time", by: Sequence[str] = ("source", "split")) -> None:
    """Samples as Parquet by source and split, in the order of time within files."""
    samples.repartitionByRange(*by, time).sortWithinPartitions(*by, time).write.partitionBy(*by).parquet(path)


def write_config(config: DataFrame, path: str) -> None:
    """A configuration or report of one row as JSON."""
    config.coalesce(1).write.json(path)


def paired_predictions(pred: DataFrame, sources: Sequence[str], key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row a key that all sources have, with <source>_pred and <source>_p_* columns; fails where a source repeats a key."""
    values = ("pred", "p_fog", "p_mist", "p_clear")
    mine = lambda s, v: F.max(F.when(F.col("source") == s, F.col(v))).alias(f"{s}_{v}")
    counts = [F.count_if(F.col("source") == s).alias(f"_n_{s}") for s in sources]
    wide = pred.filter(F.col("source").isin(*sources)).groupBy(*key).agg(*[mine(s, v) for s in sources for v in values], *counts)
    repeated = F.raise_error(described("a source repeats key ", *[F.col(k) for k in key])).cast("boolean")
    once = F.when(F.greatest(*[F.col(f"_n_{s}") for s in sources], F.lit(0)) > 1, repeated).otherwise(True)
    return wide.filter(once).dropna(subset=[f"{s}_pred" for s in sources]).drop(*[f"_n_{s}" for s in sources])


def write_paired_predictions(paired: DataFrame, path: str) -> None:
    paired.write.option("header", True).option("compression", "gzip").csv(path)
