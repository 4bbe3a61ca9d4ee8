"""Messages: linking replies to requests, and what repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attachments that are let in, and those among them that are parsed.
EXTENSIONS = ("xls", "xlsx", "csv", "pdf")
PARSED_EXTENSIONS = ("xls", "xlsx", "csv")


def message_ids(text: Column) -> Column:
    """The ids in angle brackets of a header, in lower case and in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"<([^<>\s]+)>"), F.lit(1)), F.lower)


def request_token(subject: Column) -> Column:
    """The token in a subject such as ``[PPREQ:...]``; else null."""
    found = F.regexp_extract(F.coalesce(subject, F.lit("")), r"\[PPREQ:([^\]\s]+)\]", 1)
    return F.when(found != "", found)


def link_replies(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """(message_key, request_id, linked_by): the request of each message, by In-Reply-To,
    else by the last of its References that a request has, else by the token.

    ``messages``: message_key, in_reply_to, references, subject. ``requests``: request_id,
    message_id, token. A message without any is linked to none.
    """
    sent = requests.select("request_id", F.lower("message_id").alias("mid")).where("mid is not null")
    tokens = requests.select(F.col("request_id").alias("by_token"), F.col("token").alias("tk")).where("tk is not null")
    keyed = messages.select("message_key", F.get(message_ids(F.col("in_reply_to")), F.lit(0)).alias("irt"), message_ids(F.col("references")).alias("refs"), request_token(F.col("subject")).alias("tk"))
    direct = keyed.join(sent.withColumnRenamed("request_id", "by_reply"), F.col("irt") == F.col("mid"), "left").drop("mid")
    listed = keyed.select("message_key", F.posexplode("refs").alias("pos", "mid")).join(sent, "mid")
    by_refs = listed.groupBy("message_key").agg(F.max_by("request_id", "pos").alias("by_reference"))
    joined = direct.join(by_refs, "message_key", "left").join(tokens, "tk", "left")
    how = F.when(F.col("by_reply").isNotNull(), "IN_REPLY_TO").when(F.col("by_reference").isNotNull(), "REFERENCES").when(F.col("by_token").isNotNull(), "REQUEST_TOKEN")
    return joined.select("message_key", F.coalesce("by_reply", "by_reference", "by_token").alias("request_id"), how.alias("linked_by"))


def first_of_each(messages: DataFrame, text: str, id_column: str) -> DataFrame:
    """(digest, first_id, copies): texts by SHA-256, with the smallest id."""
    hashed = messages.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("digest"), F.col(id_column).alias("i"))
    return hashed.groupBy("digest").agg(F.min("i").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def attachment_status(name: Column, content: Column, *, most_bytes: int = 20_000_000) -> Column:
    """ACCEPTED, or the first reason against an attachment: its size, extension or content."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    zip_, ole, pdf = head.startswith("504B0304"), head.startswith("D0CF11E0A1B11AE1"), head.startswith("25504446")
    right = F.when(extension == "xlsx", zip_).when(extension == "xls", ole).when(extension == "pdf", pdf).otherwise(F.lit(True))
    return (
        F.when(F.octet_length(content) > most_bytes, "REJECTED_SIZE").when(~extension.isin(*EXTENSIONS), "REJECTED_EXTENSION").when(~right, "REJECTED_CONTENT").otherwise("ACCEPTED")
    )


def retry_state(status: Column, retries: Column, *, most: int = 3) -> Column:
    """What a failed sending becomes: SENT stays, RETRY until ``most`` retries, then DEAD_LETTER."""
    return F.when(status == "SENT", "SENT").when(retries + 1 >= most, "DEAD_LETTER").otherwise("RETRY")
