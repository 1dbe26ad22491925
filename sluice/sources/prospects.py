"""Mail of a job network that calls for an answer: meetings, interest in a profile, recruiters.

The first kind of which a phrase stands in subject or snippet, as whole words in any case, is the message's.
Digests of recommended jobs, and mail from elsewhere, are no prospects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as T

# Senders, phrases of each kind in order, phrases of digests, reasons, the title of a message without subject.
DOMAINS = ["linkedin.com", "email.linkedin.com", "e.linkedin.com"]
_MEET = [f"{verb} {noun}" for verb in ("schedule", "scheduled", "schedule a") for noun in ("call", "chat", "interview", "meeting")]
PHRASES = {
    "meeting": ["interview", *_MEET, "calendar invite", "meeting request", "availability for", "book a time", "connect for a call"],
    "profile_interest": ["interested in your profile", "viewed your profile", "wants to connect", "would like to connect", "your profile caught", "impressed by your profile"],
    "recruiter_outreach": ["new inmail from", "new message from", "sent you an inmail", "sent you a message", "recruiter reached out", "recruiter message", "hiring for", "career opportunity", "job opportunity"],
}
DIGESTS = ["job you may be interested in", "jobs you may be interested in", "recommended job", "recommended jobs", "top job picks", "jobs matching your profile", "new job for you", "new jobs for you", "daily job alert", "weekly job alert"]
REASONS = {
    "meeting": "A meeting, interview, or scheduling signal was detected.",
    "profile_interest": "A recruiter or hiring contact showed explicit profile interest.",
    "recruiter_outreach": "Direct recruiter outreach or a specific opportunity was detected.",
}
UNTITLED = "LinkedIn recruiting activity"


def whole_words(phrases: list[str]) -> str:
    return rf"\b({'|'.join(phrases)})\b"


def category(sender: Column, subject: Column, snippet: Column) -> Column:
    """The kind of a message, null where it is no prospect; null texts are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    said = F.lower(F.concat(text(subject), F.lit(" "), text(snippet)))
    ours = T.sender_domain(text(sender)).isin(DOMAINS) | F.lower(text(sender)).contains("@linkedin.com")
    kind = F.coalesce(*[F.when(said.rlike(whole_words(phrases)), F.lit(name)) for name, phrases in PHRASES.items()])
    return F.when(ours & ~said.rlike(whole_words(DIGESTS)), kind)


def prospects(messages: DataFrame) -> DataFrame:
    """message_id, thread_id, category, title, sender, snippet (500 characters), classification_reason of the messages
    (message_id, thread_id, sender, subject, snippet) that are prospects."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    found = messages.withColumn("category", category(F.col("sender"), F.col("subject"), F.col("snippet"))).filter("category IS NOT NULL")
    title = F.coalesce(F.nullif(trimmed(F.col("subject")), F.lit("")), F.lit(UNTITLED))
    return found.select("message_id", "thread_id", "category", title.alias("title"), trimmed(F.col("sender")).alias("sender"), F.substring(trimmed(F.col("snippet")), 1, 500).alias("snippet"), reason[F.col("category")].alias("classification_reason"))
