"""Message files: headers, text and attachments."""

from __future__ import annotations

import email
import hashlib
from collections.abc import Iterable, Iterator
from email import policy
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sortament.session import ship_package

SCHEMA = (
    "path string, message_key string, raw_sha256 string, message_id string, in_reply_to string, references string, sender string, subject string, "
    "sent_at timestamp, body_text string, body_html string, attachments array<struct<name:string,content_type:string,size:bigint,sha256:string>>"
)


def parse_message(content: bytes) -> dict:
    """The parts of a message; its key is its id, else the digest of its bytes."""
    m = email.message_from_bytes(content, policy=policy.default)
    texts, htmls, attached = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename() or part.get_content_disposition() == "attachment":
            data = part.get_payload(decode=True) or b""
            attached.append({"name": part.get_filename() or "", "content_type": part.get_content_type(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        elif part.get_content_type() == "text/plain":
            texts.append(part.get_content())
        elif part.get_content_type() == "text/html":
            htmls.append(part.get_content())
    try:
        sent = pd.Timestamp(parsedate_to_datetime(str(m["Date"])))
        sent = (sent.tz_localize("UTC") if sent.tzinfo is None else sent.tz_convert("UTC")).tz_localize(None)
    except (TypeError, ValueError):
        sent = None
    digest = hashlib.sha256(content).hexdigest()
    own = str(m["Message-ID"] or "").strip().strip("<>").lower() or None
    return {
        "message_key": own or digest, "raw_sha256": digest, "message_id": own, "in_reply_to": m["In-Reply-To"] and str(m["In-Reply-To"]), "references": m["References"] and str(m["References"]),
        "sender": m["From"] and str(m["From"]), "subject": m["Subject"] and str(m["Subject"]), "sent_at": sent, "body_text": "\n".join(texts), "body_html": "\n".join(htmls), "attachments": attached,
    }


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``.eml`` file in a folder; each message once, by its key."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", "content")

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **parse_message(c)} for p, c in zip(batch["path"], batch["content"], strict=True)])

    return files.mapInPandas(parse, SCHEMA).dropDuplicates(["message_key"])
