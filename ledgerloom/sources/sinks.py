"""Writers: idempotent appends, snapshots, quarantine."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import first_write_wins


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and fs.listStatus(p) else None


def append_new(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Appends rows whose key is not stored yet; running it twice changes nothing."""
    first_write_wins(rows, read_or_none(rows.sparkSession, path), key, order).write.mode("append").parquet(path)


def load_extraction(facts: DataFrame, filings: DataFrame, collections: DataFrame, root: str) -> None:
    """Parents before children, so that no stored fact lacks its filing; facts of unknown filings are left out."""
    append_new(collections, os.path.join(root, "collections"), "collection_id", ["company"])
    append_new(filings, os.path.join(root, "filings"), "filing_id", ["version"])
    known = facts.sparkSession.read.parquet(os.path.join(root, "filings")).select("filing_id").distinct()
    append_new(facts.join(known, "filing_id", "left_semi"), os.path.join(root, "financial_facts"), "fact_id", ["filing_id", "concept"])


def quarantine(rows: DataFrame, path: str, key: str, form: str, reason: str) -> None:
    """Appends (doc_id, detected_format, reason, at)."""
    rows.select(F.col(key).cast("string").alias("doc_id"), F.col(form).alias("detected_format"), F.lit(reason).alias("reason"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def fan_out(writers: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], dict[str, str]]:
    """A function for foreachBatch that hands a batch to every writer; one that fails is logged and does not keep the others from theirs.

    It returns the failures by name. Writers must be idempotent, as a batch may come again.
    """

    def run(batch: DataFrame, number: int) -> dict[str, str]:
        failed = {}
        for name, write in writers.items():
            try:
                write(batch)
            except Exception as e:
                failed[name] = str(e)
                logging.getLogger(__name__).warning("batch %s: writer %s failed: %s", number, name, e)
        return failed

    return run


def mark_ingested(rows: DataFrame, path: str, hash_: str = "content_hash") -> None:
    """The ledger of contents that were processed; called after success."""
    append_new(rows.select(hash_, "doc_id"), path, hash_, ["doc_id"])
