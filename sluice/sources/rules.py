"""Portal rules and suppress rules: small tables that a person edits, in order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(mail: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds portal: the first rule whose domain ends the sender's, or stands in the
    address, and whose subject or signal words, if any, occur; a rule without domains
    needs a subject word. The rules become one conditional, in their order."""
    host = F.lower(F.regexp_extract("sender", r"@([^>\s]+)", 1))
    subject = F.lower(F.coalesce("subject", F.lit("")))
    out = F.lit(None).cast("string")
    has = lambda words: F.lit(False) if not words else subject.rlike("|".join(re.escape(w.lower()) for w in words))
    for rule in reversed(rules):
        domains = [d.lower() for d in rule.get("domains", [])]
        words = [*rule.get("subjects", []), *rule.get("signals", [])]
        at = F.lit(not domains)
        for d in domains:
            at |= (host == d) | host.endswith(f".{d}")
        hit = at & (has(words) if words or not domains else F.lit(True))
        out = F.when(hit, F.lit(rule["portal"])).otherwise(out)
    return mail.withColumn("portal", out)


def unsuppressed(mail: DataFrame, rules: list[dict]) -> DataFrame:
    """Mail that no suppress rule matches: sender and, where given, subject or snippet.
    Patterns that aren't valid are left out."""
    text = F.concat_ws(" ", "subject", "snippet")
    bad = F.lit(False)
    for rule in rules:
        try:
            re.compile(rule["sender"]), re.compile(rule.get("subject") or "")
        except re.error:
            continue
        hit = F.coalesce(F.col("sender").rlike(f"(?i){rule['sender']}"), F.lit(False))
        bad |= hit & text.rlike(f"(?i){rule['subject']}") if rule.get("subject") else hit
    return mail.filter(~bad)
