"""Folding of ingestion events, and roll-ups over span trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Statuses by precedence.
PRECEDENCE = ("running", "failed", "done", "deferred", "skipped")


def latest_stages(events: DataFrame, unit: str, stage: str, status: str, seq: str) -> DataFrame:
    """(unit, stage, first_seq, status): order by the first event of a stage, value by the last."""
    return events.groupBy(unit, stage).agg(F.min(seq).alias("first_seq"), F.max_by(status, seq).alias("status"))


def macro_status(stages: DataFrame, unit: str, group: str, status: str) -> DataFrame:
    """(unit, group, status): the status that comes first in precedence."""
    names = F.array(*[F.lit(s) for s in PRECEDENCE])
    place = F.nullif(F.array_position(names, F.col(status)), F.lit(0))
    best = F.min(F.coalesce(place, F.lit(len(PRECEDENCE)))).cast("int")
    return stages.groupBy(unit, group).agg(best.alias("place")).select(unit, group, F.element_at(names, F.col("place")).alias("status"))


def folded_states(events: DataFrame, unit: str, kind: str, seq: str, stage: str, status: str, outcome: str) -> DataFrame:
    """(unit, stage, status, outcome): the latest of each since the unit's last upload; units that were never uploaded have no row.

    kind is upload, node or done. An upload resets what came before, so one aggregate with the latest of each kind is enough.
    """
    of = lambda k, *c: F.max(F.when(F.col(kind) == k, F.struct(F.col(seq).alias("at"), *c)))
    rows = events.groupBy(unit).agg(F.max(F.when(F.col(kind) == "upload", F.col(seq))).alias("reset"), of("node", F.col(stage).alias("stage"), F.col(status).alias("status")).alias("n"), of("done", F.col(outcome).alias("outcome")).alias("d")).where("reset is not null")
    since = lambda c, f: F.when(F.col(f"{c}.at") > F.col("reset"), F.col(f"{c}.{f}")).alias(f)
    return rows.select(unit, since("n", "stage"), since("n", "status"), since("d", "outcome"))


def uploads_traced(docs: DataFrame, trace: DataFrame, limit: int = 100) -> DataFrame:
    """(upload_id, place, doc_id, status, trace): documents of the latest uploads with their stages in order.

    docs: (doc_id, upload_id, created, stage, outcome); trace: (doc_id, first_seq, stage, status), one row for each stage.
    The limit counts uploads, as the listing does; their documents stay rows, so a large upload is not gathered.
    """
    latest = docs.groupBy("upload_id").agg(F.max("created").alias("at")).orderBy(F.desc("at"), "upload_id").limit(limit)
    latest = latest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "upload_id"))).drop("at")
    steps = trace.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "stage", "status"))).alias("s"))
    steps = steps.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["stage"], x["status"])), ",").alias("trace"))
    status = F.coalesce("outcome", F.when(F.col("stage").isNotNull(), "processing").otherwise("pending")).alias("status")
    rows = docs.join(latest, "upload_id").join(steps, "doc_id", "left")
    return rows.select("upload_id", "place", "doc_id", status, F.coalesce("trace", F.lit("")).alias("trace"))


def subtree_sums(spans: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(node, total): each span's value with those of all spans below it.

    Pointers double: in round k each span hands the sum of its nearest 2^k levels to the ancestor 2^k levels
    up, so a chain of n spans takes log n rounds of n rows, each written to the shared folder, and no
    table of ancestors is made. Spans that are their own ancestor, or whose parent is unknown or
    null, count as roots; rows of a span that comes twice are one span with the sum of its values.
    """
    once = spans.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.min(parent).alias("up"), F.coalesce(F.sum(value), F.lit(0)).alias("v"), F.count(value).alias("c"))
    known = once.select(F.col("n").alias("up"), F.lit(True).alias("known"))
    rows = once.join(known, "up", "left").select("n", "v", "c", F.when(F.col("known") & (F.col("up") != F.col("n")), F.col("up")).alias("up"))
    now = written(rows)
    count = now.count()
    hop = lambda at: at.join(at.select(F.col("n").alias("up"), F.col("up").alias("far")), "up", "left")

    # after as many doublings as there are spans, whoever still has an ancestor stands on or below a ring,
    # and its ancestor is on it
    ring = now.select("n", "up")
    for _ in range(count.bit_length()):
        ring = written(hop(ring).select("n", F.col("far").alias("up")))
        if ring.where("up is not null").isEmpty():
            break
    own = ring.where("up is not null").select(F.col("up").alias("n"), F.lit(True).alias("ring")).distinct()
    now = now.join(own, "n", "left").select("n", "v", "c", F.when(F.col("ring").isNull(), F.col("up")).alias("up"))

    while True:
        now = written(now)
        if now.where("up is not null").isEmpty():
            return now.select(F.col("n").alias(node), F.when(F.col("c") > 0, F.col("v")).alias("total"))
        own = now.select("n", "v", "c")
        handed = now.where("up is not null").select(F.col("up").alias("n"), "v", "c")
        sums = own.unionByName(handed).groupBy("n").agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
        now = hop(now.select("n", "up")).select("n", F.col("far").alias("up")).join(sums, "n")
