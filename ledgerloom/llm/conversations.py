"""Rebuilding ordered conversations from message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

# Wordings of the two sides.
USER = ("user", "usr", "human", "customer", "client", "person", "me", "end user", "end-user", "enduser", "questioner", "prompter")
ASSISTANT = ("assistant", "asst", "ai", "bot", "model", "chatbot", "machine", "agent", "gpt", "llm", "ai assistant", "ai-assistant", "chat bot")
#: Keys of the message's JSON that name the message it answers.
REPLY_KEYS = ("reply_to", "in_reply_to", "parent_id")


def side(role: Column) -> Column:
    """user, assistant, or null for any other role."""
    r = F.lower(F.regexp_replace(role, r"^[\s :]+|[\s :]+$", ""))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant")


def session_key(c: Column) -> Column:
    """Ids are equal regardless of case and outer white space; blank ids are null."""
    k = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(k != "", k)


def one_row_each(messages: DataFrame) -> DataFrame:
    """Rows with equal id are one message, with the largest value present for each field; rows without id go."""
    known = ["session_id", "role", "text", "meta", "created_at"]
    rows = messages.select("id", *known).withColumn("session_id", session_key(F.col("session_id"))).where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(*[F.max(c).alias(c) for c in known])


def links(messages: DataFrame) -> DataFrame:
    """(a, b) message ids: replies named in meta, and quotes ("> text" lines at the start) of another message's text.

    A quoted text that several messages share links to the first id, so hot texts make no pairs.
    """
    replies = [F.get_json_object("meta", f"$.{k}") for k in REPLY_KEYS]
    reply = messages.select(F.col("id").alias("a"), F.coalesce(*replies).alias("b")).where(F.col("b").isNotNull())
    reply = reply.join(messages.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    quoted = F.regexp_extract("text", r"^((?:>[^\n]*(?:\n|$))+)", 1)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    quote = messages.select("id", quoted.alias("q")).where(F.col("q") != "").select(F.col("id").alias("a"), F.xxhash64(plain(F.regexp_replace("q", r"(?m)^>\s?", ""))).alias("h"))
    said = messages.where(F.col("text").isNotNull()).select("id", F.xxhash64(plain(F.col("text"))).alias("h"))
    said = said.join(quote.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("id").alias("b"))
    return reply.unionByName(quote.join(said, "h").select("a", "b"))


def with_conversation(messages: DataFrame) -> DataFrame:
    """Adds conversation: the session's key or, for messages without one, the key of the session
    that their reply and quote links lead to, or else "linked:" and the component's first id.

    If links join two sessions, the messages without session go to the smaller key. Messages that
    have neither a session nor a link get null.
    """
    found = links(messages)
    if found.isEmpty():
        return messages.withColumn("conversation", F.col("session_id"))
    parts = connected_components(found).withColumnRenamed("node", "id")
    named = parts.join(messages.select("id", "session_id"), "id").groupBy("component").agg(F.min("session_id").alias("s"))
    lost = parts.join(named, "component").select("id", F.coalesce("s", F.concat(F.lit("linked:"), "component")).alias("by_link"))
    return messages.join(lost, "id", "left").withColumn("conversation", F.coalesce("session_id", "by_link")).drop("by_link")


def rebuild(messages: DataFrame, sessions: DataFrame | None = None, keep_linked: bool = False) -> DataFrame:
    """(session_id, turn, message_id, role, text, created_at) of every kept conversation.

    Order: created_at, at equal times the question before its reply, then id. A message repeated
    directly after itself (same side and text) is one turn under its first id. Kept are
    conversations of known sessions whose messages all have created_at, a text with a letter or
    digit and a role of one of the two sides, and whose turns alternate from user to assistant.
    With keep_linked, conversations rebuilt from links alone stay as well. Null or repeated
    sessions, empty tables and extra columns do no harm.

    Broken conversations are found by one aggregate before anything is sorted. Neighbours are
    compared in windows over (conversation, hour), and hours are chained by their first and last
    turns alone, so that one conversation with a third of all messages is spread over its hours.
    """
    rows = with_conversation(one_row_each(messages)).where(F.col("conversation").isNotNull())
    rows = rows.withColumn("side", side(F.col("role")))
    sound = F.col("side").isNotNull() & F.col("created_at").isNotNull() & F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    kept = rows.groupBy("conversation").agg(F.min(sound).alias("sound"), F.count_if(F.col("side") == "assistant").alias("replies")).where(F.col("sound") & (F.col("replies") > 0)).select("conversation")
    if sessions is not None:
        known = sessions.select(session_key(F.col("id")).alias("conversation")).where(F.col("conversation").isNotNull()).distinct()
        there = kept.join(known, "conversation", "left_semi")
        kept = there.unionByName(kept.where(F.col("conversation").startswith("linked:"))).distinct() if keep_linked else there
    rows = rows.join(kept, "conversation", "left_semi").withColumns({"hour": F.date_trunc("hour", "created_at"), "said": F.xxhash64("side", "text")})

    order = ["created_at", F.col("side").desc(), "id"]
    within = Window.partitionBy("conversation", "hour").orderBy(*order)
    local = rows.withColumns({"said_before": F.lag("said").over(within), "n": F.row_number().over(within)})
    at = F.struct("created_at", F.when(F.col("side") == "user", 0).otherwise(1).alias("k"), "id")
    hours = local.groupBy("conversation", "hour").agg(F.max_by("said", at).alias("last_said"))
    chain = Window.partitionBy("conversation").orderBy("hour")
    hours = hours.select("conversation", "hour", F.lag("last_said").over(chain).alias("hour_before"))
    joined = local.join(hours, ["conversation", "hour"])
    before = F.when(F.col("n") == 1, F.col("hour_before")).otherwise(F.col("said_before"))
    turns = joined.where(before.isNull() | (before != F.col("said"))).drop("said_before", "n", "hour_before")

    side_before = F.lag("side").over(within)
    numbered = turns.withColumns({"k": F.row_number().over(within), "alternates": F.coalesce(side_before != F.col("side"), F.lit(True))})
    hours = numbered.groupBy("conversation", "hour").agg(
        F.count("*").alias("size"), F.min("alternates").alias("alternates"), F.min_by("side", at).alias("first"), F.max_by("side", at).alias("last")
    )
    hours = hours.withColumns(
        {"skip": F.coalesce(F.sum("size").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "came": F.lag("last").over(chain)}
    )
    fits = F.col("alternates") & F.when(F.col("came").isNull(), F.col("first") == "user").otherwise(F.col("came") != F.col("first"))
    good = hours.groupBy("conversation").agg(F.min(fits).alias("fits"), F.max_by("last", "hour").alias("last")).where(F.col("fits") & (F.col("last") == "assistant"))
    skips = hours.join(good.select("conversation"), "conversation", "left_semi").select("conversation", "hour", "skip")
    out = numbered.join(skips, ["conversation", "hour"])
    return out.select(
        F.col("conversation").alias("session_id"), (F.col("k") + F.col("skip")).cast("int").alias("turn"), F.col("id").alias("message_id"), F.col("side").alias("role"), "text", "created_at"
    )


def found(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The turns under the session's own spelling of its id."""
    spelled = sessions.where(F.col("id").isNotNull()).groupBy(session_key(F.col("id")).alias("session_id")).agg(F.min("id").alias("own"))
    return rebuild(messages, sessions).join(spelled, "session_id").select(F.col("own").alias("session_id"), "turn", "message_id")
