"""Which mail is a prospect."""

from sluice.sources import prospects as P

OURS = "LinkedIn <messages-noreply@linkedin.com>"
CASES = [
    ("A recruiter wants to schedule a call", "", OURS, "meeting"),
    ("Priya sent you a message", "Career opportunity", OURS, "recruiter_outreach"),
    ("A recruiter is interested in your profile", None, OURS, "profile_interest"),
    ("10 jobs you may be interested in", "interview", OURS, None),
    ("Schedule a call", "", "unknown@example.com", None),
    ("Interviewing tips", "", OURS, None),
    (None, "BOOK A TIME", "x@e.linkedin.com", "meeting"),
    ("hello", "", OURS, None),
    ("viewed your profile; interview", "", OURS, "meeting"),
    ("hiring for", "", None, None),
]


def test_prospects(spark):
    rows = [(str(i), "t", sender, subject, snippet) for i, (subject, snippet, sender, _) in enumerate(CASES)]
    found = {r.message_id: r for r in P.prospects(spark.createDataFrame(rows, "message_id string, thread_id string, sender string, subject string, snippet string")).collect()}
    assert {i: r.category for i, r in found.items()} == {str(i): c[3] for i, c in enumerate(CASES) if c[3]}
    assert found["6"].title == P.UNTITLED and found["6"].snippet == "BOOK A TIME" and found["0"].classification_reason == P.REASONS["meeting"]
