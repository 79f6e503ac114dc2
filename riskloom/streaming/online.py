"""SRC4: JSON payloads as a stream, with a side table of those that are rejected.

One payload a line.  A line that is no JSON object, or whose amount is absent or
no finite number, goes to the rejected table with its text and the reason; the
others are coerced, completed and scored with the online profile.  Both tables
have a folder for each micro-batch, written anew when a batch is retried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.validate import coerce_online, number, split_valid


def payload_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that appear under ``path``, as ``payload``."""
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.text(path).withColumnRenamed("value", "payload")


def split_payloads(lines: DataFrame, id_col: str = "txn_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): typed online transactions with their id; (id, payload, quarantine_reason)."""
    fine = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    ident = F.when(fine, number(F.get_json_object("payload", f"$.{id_col}"))).cast("long")
    tagged = lines.withColumns({id_col: ident, "_fine": fine})
    broken = tagged.filter(~F.col("_fine")).select(id_col, "payload", F.lit("malformed JSON").alias("quarantine_reason"))
    valid, bad = split_valid(coerce_online(tagged.filter("_fine").withColumn("_text", F.col("payload")).drop("_fine")))
    rejected = bad.select(id_col, F.col("_text").alias("payload"), "quarantine_reason").union(broken)
    return valid.drop("amount_text", "_text"), rejected


def online_sink(score: Callable[[DataFrame], DataFrame], scored_path: str, rejected_path: str):
    """foreachBatch writer of scored and rejected payloads."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # read for both tables
        try:
            valid, rejected = split_payloads(batch)
            score(valid).write.mode("overwrite").parquet(f"{scored_path}/epoch={epoch_id}")
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    return write
