"""Landed mail: messages as JSON with headers and a tree of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "struct<mimeType:string,body:struct<data:string>"
#: Parts within parts, as deep as real messages go.
DEPTH = 6


def _schema(depth: int) -> str:
    inner = f",parts:array<{_schema(depth - 1)}>" if depth else ""
    return f"{_PART}{inner}>"


SCHEMA = f"id string, threadId string, internalDate string, snippet string, payload struct<mimeType:string,headers:array<struct<name:string,value:string>>,body:struct<data:string>,parts:array<{_schema(DEPTH)}>>"


def header(name: str) -> Column:
    hit = F.filter("payload.headers", lambda h: F.lower(h["name"]) == name.lower())
    return F.get(hit, 0)["value"]


def _texts(part: Column, depth: int) -> Column:
    own = F.when(F.lower(part["mimeType"]) == "text/plain", part["body"]["data"])
    if depth < 0:
        return F.array_compact(F.array(own))
    return F.concat(F.array_compact(F.array(own)), F.coalesce(F.flatten(F.transform(part["parts"], lambda p: _texts(p, depth - 1))), F.array().cast("array<string>")))


def decode(messages: DataFrame, column: str = "value") -> DataFrame:
    """message_id, thread_id, sender, subject, date (the header's, or else when it
    arrived), snippet and the first plain text of the body."""
    m = messages.select(F.from_json(column, SCHEMA).alias("m")).select("m.*")
    arrived = F.timestamp_millis(F.expr("try_cast(internalDate AS bigint)"))
    sent = F.regexp_extract(header("Date"), r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ?([+-]\d{4})?", 0)
    date = F.coalesce(F.try_to_timestamp(sent, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(sent, F.lit("d MMM yyyy HH:mm:ss")), arrived)
    raw = F.get(_texts(F.col("payload"), DEPTH), 0)
    body = F.decode(F.try_to_binary(F.translate(raw, "-_", "+/"), F.lit("base64")), "UTF-8")
    return m.select(F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), header("From").alias("sender"), header("Subject").alias("subject"), date.alias("date"), "snippet", body.alias("body_text"))
