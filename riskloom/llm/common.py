"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# white space of the word definition `[^\x20\x09-\x0D]+`
SPACE = r"[\x20\x09-\x0D]+"


def register(name: str):
    """Register ``(spark, sf_dir) -> DataFrame`` as the query ``name``."""

    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run

    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles whose frames are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` reliably to ``spark.checkpoint.dir`` and read it from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = cut_lineage(df)
    del df
    release(spark)
    return out


class Scratch:
    """Intermediate tables as compressed Parquet in ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        del df
        release(self.spark)
        out = self.spark.read.parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def once(col):
    """``col``, evaluated once a row: the optimiser neither copies a projection
    with a non-deterministic part into its consumers nor pushes filters through
    it, which would put a whole-text expression inside another one's lambda."""
    return F.when(F.spark_partition_id() >= 0, col)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not used in ``df``, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file (the same on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)
