"""Chat exports as documents: messages in order, replies below their parents.

Messages: ``channel, month, ts, user, username, text, thread_ts, has_files``; users: ``id, display``.
A document is kept as *ordered lines*; a channel month of any size is sorted by Spark, never
gathered into one value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.lets import none_if_blank

DOC = ["channel", "month"]
_MENTION = "<@([A-Z0-9]+)>"


def display_name(user: Column) -> Column:
    """Display name of a user record with its fallbacks."""
    return F.coalesce(*[none_if_blank(c) for c in (
        user["profile"]["display_name"], user["profile"]["real_name"], user["name"], user["id"])])


def document_id(channel: Column, month: Column) -> Column:
    return F.concat(F.lit("slack-"), F.substring(F.sha1(F.concat_ws("/", channel, month)), 1, 12))


def substitute_mentions(messages: DataFrame, users: DataFrame, key: list[str]) -> DataFrame:
    """``<@ID>`` becomes ``@Name``; only messages with a mention take part in the join."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(_MENTION), F.lit(1)))
    named = (messages.filter(F.col("text").rlike(_MENTION)).select(*key, F.explode(ids).alias("id"))
             .join(users.select("id", "display"), "id", "left")
             .groupBy(*key).agg(F.collect_list(F.struct(
                 "id", F.coalesce("display", "id").alias("display"))).alias("_names")))
    filled = F.aggregate("_names", F.col("text"), lambda acc, n: F.replace(
        acc, F.concat(F.lit("<@"), n["id"], F.lit(">")), F.concat(F.lit("@"), n["display"])))
    return (messages.join(named, key, "left")
            .withColumn("text", F.when(F.col("_names").isNotNull(), filled).otherwise(F.col("text"))).drop("_names"))


def conversation_lines(messages: DataFrame, users: DataFrame) -> DataFrame:
    """channel, month, block_ts, block_kind, is_reply, ts, line: sort by these keys to read it."""
    kept = messages.filter((F.coalesce("text", F.lit("")) != "") | F.coalesce("has_files", F.lit(False)))
    kept = kept.withColumn("text", F.coalesce("text", F.lit("")))
    is_reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != "") & (F.col("thread_ts") != F.col("ts"))
    top = kept.filter(~is_reply)
    replies = kept.filter(is_reply)
    parents = top.select(*DOC, F.col("ts").alias("thread_ts")).distinct().withColumn("_found", F.lit(True))
    placed = replies.join(parents, [*DOC, "thread_ts"], "left")
    nested = placed.filter(F.col("_found")).drop("_found").withColumns(
        {"block_ts": F.col("thread_ts"), "block_kind": F.lit(0), "is_reply": F.lit(1)})
    orphans = placed.filter(F.col("_found").isNull()).drop("_found").withColumns(
        {"block_ts": F.col("ts"), "block_kind": F.lit(1), "is_reply": F.lit(0)})
    tops = top.withColumns({"block_ts": F.col("ts"), "block_kind": F.lit(0), "is_reply": F.lit(0)})
    lines = tops.unionByName(nested).unionByName(orphans)
    lines = substitute_mentions(lines, users, [*DOC, "ts", "user"])
    lines = lines.join(users.select(F.col("id").alias("user"), F.col("display").alias("_who")), "user", "left")
    seconds = F.coalesce(F.col("ts").try_cast("double"), F.lit(0.0))
    indent = F.when(F.col("is_reply") == 1, F.lit("    ↳ ")).otherwise(F.lit(""))
    mark = F.when(F.col("block_kind") == 1, F.lit("↳ ")).otherwise(F.lit(""))
    who = F.coalesce("_who", none_if_blank(F.col("user")), none_if_blank(F.col("username")), F.lit("unknown"))
    body = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), indent, F.lit("  ")))
    line = F.concat(mark, indent, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"),
                    F.lit(" — "), who, F.lit(": "), body)
    return lines.select(*DOC, F.col("block_ts").try_cast("double").alias("block_ts"), "block_kind", "is_reply",
                        seconds.alias("ts"), line.alias("line"))


def conversation_documents(lines: DataFrame, team: str = "") -> DataFrame:
    """Inventory rows of the non-empty documents with an order-free content fingerprint."""
    from sourceloom.operators.dossiers import member_print
    a, b = member_print(F.concat_ws("|", "block_ts", "block_kind", "is_reply", "ts", "line"))
    uri = (F.concat(F.lit(f"https://{team}.slack.com/archives/"), "channel") if team
           else F.concat(F.lit("slack://"), "channel", F.lit("/"), "month"))
    return (lines.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("lines"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), a.cast("string"), b.cast("string")).alias("fingerprint"))
        .select(document_id(F.col("channel"), F.col("month")).alias("file_id"),
                F.concat("channel", F.lit(" "), "month", F.lit(".md")).alias("name"),
                F.concat(F.lit("slack/"), "channel", F.lit("/"), "month", F.lit(".md")).alias("local_path"),
                F.concat(F.lit("/Slack/"), "channel", F.lit("/"), "month", F.lit(".md")).alias("drive_path"),
                F.col("channel").alias("org_unit"), uri.alias("source_uri"),
                F.lit("text/markdown").alias("mime_type"), "fingerprint", "lines"))


def write_documents(lines: DataFrame, target: str) -> None:
    """Text files per channel and month, lines in reading order inside each file sequence."""
    (lines.repartitionByRange(*DOC, "block_ts", "block_kind", "is_reply", "ts")
     .sortWithinPartitions(*DOC, "block_ts", "block_kind", "is_reply", "ts")
     .select(*DOC, "line").write.mode("overwrite").partitionBy(*DOC).text(target))
