"""Structured Streaming: ingestion, event folding, windows, bundles and screened token streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators.redaction import masked
from ..sources import sinks

BOUNDARY = re.compile(r"(?<=[.!?])\s+|\n+")


def events_stream(spark: SparkSession, folder: str, schema, time: str = "ts", files_per_batch: int = 1) -> DataFrame:
    """A parquet folder as a stream, its time as a timestamp so that it can carry a watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from its start; the checkpoint takes the place of committed offsets. Needs the Kafka connector."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): activity with no pause of the gap or more."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def folded(events: DataFrame, unit: str, stage: str, status: str, seq: str) -> DataFrame:
    """Latest status per unit and stage as a streaming aggregate (update or complete mode)."""
    return events.groupBy(unit, stage).agg(F.min(seq).alias("first_seq"), F.max_by(status, seq).alias("status"))


def ingest(stream: DataFrame, ledger: str, target: str, checkpoint: str, hash_: str = "content_hash") -> StreamingQuery:
    """Stores contents that the ledger lacks, then marks them; a batch that is run again changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        seen = sinks.read_or_none(rows.sparkSession, ledger)
        fresh = rows if seen is None else rows.join(seen.select(hash_), hash_, "left_anti")
        sinks.append_new(fresh, target, hash_, ["doc_id"])
        sinks.mark_ingested(fresh, ledger, hash_)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, hash_: str = "content_hash", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First arrival of each content within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([hash_])


def completed_bundles(stream: DataFrame) -> DataFrame:
    """(folder, stem, instance, schema) once both files of a bundle have arrived, in whatever order, once each.

    stream: (folder, stem, ext, key). The state of a bundle is two keys.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        instance, schema, done = state.get if state.exists else (None, None, False)
        for pdf in batches:
            for ext, k in zip(pdf["ext"], pdf["key"]):
                if ext == ".xsd":
                    schema = schema or k
                elif ext in (".htm", ".html", ".xml"):
                    instance = instance or k
        ready = instance is not None and schema is not None and not done
        state.update((instance, schema, bool(done or ready)))
        if ready:
            yield pd.DataFrame([(*key, instance, schema)], columns=["folder", "stem", "instance", "schema"])

    out = "folder string, stem string, instance string, schema string"
    return stream.groupBy("folder", "stem").applyInPandasWithState(step, out, "instance string, schema string, done boolean", "append", GroupStateTimeout.NoTimeout)


def blocked(segment: str) -> bool:
    return any(re.search(p, segment, re.I) for _, p in rules.OUTPUT_RULES)


def screened(stream: DataFrame) -> DataFrame:
    """(answer_id, n, text): a token stream released sentence by sentence.

    stream: (answer_id, seq, delta, last). A sentence waits until it is complete; identifiers in it are
    masked; the first one that the output guard blocks ends the answer. The state is the rest of the
    text, the number of sentences and whether the answer was cut.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, cut = state.get if state.exists else ("", 0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for delta, last in zip(rows["delta"], rows["last"]):
            if cut:
                break
            held += delta or ""
            while not cut and held:
                m = BOUNDARY.search(held)
                if not m and not last:
                    break
                end = m.end() if m else len(held)
                segment, held = held[:end], held[end:]
                if blocked(segment):
                    cut, held = True, ""
                else:
                    out.append((key[0], n, masked(segment)[0]))
                    n += 1
        state.update((held, n, cut))
        yield pd.DataFrame(out, columns=["answer_id", "n", "text"])

    return stream.groupBy("answer_id").applyInPandasWithState(step, "answer_id string, n int, text string", "held string, n int, cut boolean", "append", GroupStateTimeout.NoTimeout)


def run_now(df: DataFrame, mode: str, checkpoint: str, name: str) -> DataFrame:
    """Runs a stream over what is there and returns the result from memory; for tests and small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
