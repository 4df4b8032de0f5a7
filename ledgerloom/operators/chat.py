"""Chat sessions and turns, guards over messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx

#: Parts that the numbers of one session are spread over.
SALTS = 16


def one_message_each(messages: DataFrame) -> DataFrame:
    """Rows with equal id once: the smallest row by time."""
    rest = [c for c in messages.columns if c not in ("id", "created_at")]
    return messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("created_at", *rest)).alias("m")).select("id", "m.*")


def recent_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    """(session_id, turn, role, text): the last n messages of each session, oldest first.

    Spark keeps n rows per session and task before the shuffle.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = one_message_each(messages).where("session_id is not null and created_at is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    again = Window.partitionBy("session_id").orderBy(F.desc("back"))
    return last.withColumn("turn", F.row_number().over(again)).select("session_id", "turn", "id", "role", "text")


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, place, id, role, text): all messages of each session by time, then id; without a time first.

    Messages are numbered within hours, and hours by running counts, so that a session with a third of all
    messages is spread over its hours.
    """
    rows = one_message_each(messages).where("session_id is not null").withColumn("hour", F.date_trunc("hour", "created_at"))
    within = Window.partitionBy("session_id", "hour").orderBy(F.asc_nulls_first("created_at"), "id")
    hours = Window.partitionBy("session_id").orderBy(F.asc_nulls_first("hour")).rowsBetween(Window.unboundedPreceding, -1)
    skip = rows.groupBy("session_id", "hour").agg(F.count("*").alias("n")).select("session_id", F.col("hour").alias("at"), F.coalesce(F.sum("n").over(hours), F.lit(0)).alias("skip"))
    numbered = rows.withColumn("k", F.row_number().over(within)).withColumnRenamed("session_id", "session")
    joined = numbered.join(skip, (F.col("session") == F.col("session_id")) & F.col("hour").eqNullSafe(F.col("at")))
    return joined.select("session_id", (F.col("k") + F.col("skip")).cast("int").alias("place"), "id", "role", "text")


def session_list(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """Each user's sessions, latest first, at most limit (the page size of the listing)."""
    rest = [c for c in sessions.columns if c != "id"]
    once = sessions.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", "s.*")
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("user_id", "place", "id", "title")


def guarded(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds input_category and output_category: what a guard would block the text for, else null."""
    return messages.withColumns({"input_category": rules.first_rule(F.col(text), rules.INPUT_RULES), "output_category": rules.first_rule(F.col(text), rules.OUTPUT_RULES)})


def renamed(sessions: DataFrame, id_: str, title: str) -> DataFrame:
    """The sessions with a new title for one of them."""
    return sessions.withColumn("title", F.when(F.col("id") == id_, F.lit(title)).otherwise(F.col("title")))


def without_session(sessions: DataFrame, messages: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session; its messages go with it."""
    return sessions.where(~F.col("id").eqNullSafe(F.lit(id_))), messages.where(~F.col("session_id").eqNullSafe(F.lit(id_)))


def numeric_grounding(messages: DataFrame) -> DataFrame:
    """(id, figures, grounding): for each reply of a session with questions, the number of its figures and the
    share of them that stand verbatim in a question of the session; 1 if it has none.

    A figure lies within one run of digits and marks, so the runs' stretches that are as long as some figure
    of the session are joined with the figures; no session is gathered, nor a question compared with a reply.
    """
    m = one_message_each(messages).where("text is not null and session_id is not null").withColumn("side", rules.side(F.col("role")))
    asked = m.where("side = 'user'")
    replies = m.where("side = 'assistant'").join(asked.select("session_id").distinct(), "session_id", "left_semi")
    replies = replies.select("id", "session_id", tx.figures(F.col("text")).alias("nums"))
    said = replies.select("id", "session_id", F.explode("nums").alias("figure"))
    figures = said.select("session_id", "figure").distinct()
    # a session's few lengths go to each of its salts
    size = F.char_length("figure").alias("size")
    sizes = figures.select("session_id", size).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    runs = asked.select("session_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9][0-9,.]*)"), 1)).alias("run"))
    runs = runs.distinct().withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int"))
    long_enough = runs.join(sizes, ["session_id", "salt"]).where(F.char_length("run") >= F.col("size"))
    starts = F.explode(F.sequence(F.lit(1), F.char_length("run") - F.col("size") + 1))
    stretches = long_enough.withColumn("at", starts).select("session_id", F.col("run").substr(F.col("at"), F.col("size")).alias("figure"))
    stood = figures.join(stretches.distinct(), ["session_id", "figure"], "left_semi").withColumn("stood", F.lit(1))
    share = F.round(F.count("stood") / F.count("figure"), 6).alias("grounding")
    out = said.join(stood, ["session_id", "figure"], "left").groupBy("id").agg(F.count("figure").cast("int").alias("figures"), share)
    return out.unionByName(replies.where(F.size("nums") == 0).select("id", F.lit(0).alias("figures"), F.lit(1.0).alias("grounding")))
