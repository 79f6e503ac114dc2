"""Declared-schema readers.

Parquet tables carry their own schema; CSV and JSON are never inferred.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.schemas import METRICS_DOCUMENT, ONLINE_TRANSACTION, RAW_TRANSACTION

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_raw_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC1: raw transaction table with the declared 11-column schema."""
    reader = spark.read.schema(RAW_TRANSACTION)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return reader.format(fmt).load(path)


def read_online_transactions(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: JSON-lines transactions, every field optional."""
    return spark.read.schema(ONLINE_TRANSACTION).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the metrics document (one multi-line JSON object)."""
    return spark.read.schema(METRICS_DOCUMENT).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK1/SNK3: overwrite a Parquet table (no index column exists in Spark)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of the names, sizes and times of all files under ``paths``."""
    found = []
    for path in paths:
        fs, p = _path(spark, path)
        top = fs.getFileStatus(p)
        files = [top] if top.isFile() else []
        if not files:
            it = fs.listFiles(p, True)
            while it.hasNext():
                files.append(it.next())
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    return hashlib.sha1(repr(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, cache_root: str, paths: list[str], version: str, build: Callable[[str], None]) -> str:
    """SRC2: the folder that ``build(folder)`` filled from ``paths`` under feature ``version``.

    A manifest, written after everything else, names the folder and the inputs'
    fingerprint.  Without one, or when the inputs have changed, a new folder is
    built beside the old one; an error while reading never rebuilds or overwrites."""
    key = hashlib.sha1(repr((sorted(paths), version)).encode()).hexdigest()[:16]
    root = f"{cache_root.rstrip('/')}/processed-{key}"
    state = fingerprint(spark, paths)
    fs, manifest = _path(spark, f"{root}/manifest")
    if fs.exists(manifest):
        known = spark.read.schema("fingerprint string, version string, folder string").json(f"{root}/manifest").first()
        if known and known["fingerprint"] == state:
            return f"{root}/{known['folder']}"
    folder = f"data-{uuid.uuid4().hex}"
    build(f"{root}/{folder}")
    # a new manifest takes the place of the old one when it is complete
    spark.createDataFrame([(state, version, folder)], "fingerprint string, version string, folder string").coalesce(1) \
        .write.json(f"{root}/{folder}.manifest")
    fs.delete(manifest, True)
    fs.rename(_path(spark, f"{root}/{folder}.manifest")[1], manifest)
    return f"{root}/{folder}"


def processed_or_compute(spark: SparkSession, cache_root: str, raw_path: str, version: str,
                         compute) -> DataFrame:
    """SRC2: the processed table of (input, feature version), computed and saved when
    it is absent or the input has changed."""
    return spark.read.parquet(cached(spark, cache_root, [raw_path], version, lambda out: write_table(compute(), out)))
