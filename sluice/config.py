"""Fixed values of the record model: domains, stage sets, thresholds and weights."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The domains of enumerated columns.
STATUSES = ["Applied", "Resume Shortlisted", "Interview Scheduled", "Interview In Progress", "Offer Negotiation", "Offer", "Joined", "Rejected", "Withdrawn"]
EVENT_TYPES = ["Application Submitted", "Recruiter Response", "Interview Scheduled", "Interview Attended", "Offer Received", "Rejected", "Withdrawn"]
#: Milestones that an application has once.
ONCE = ["Application Submitted", "Offer Received", "Rejected"]
#: How far a status is, when merged records disagree.
RANK = {"Applied": 0, "Resume Shortlisted": 1, "Interview Scheduled": 2, "Interview In Progress": 3, "Offer Negotiation": 4, "Rejected": 4, "Withdrawn": 4, "Offer": 5, "Joined": 6}
PROSPECT_STATUSES = ["new", "reviewed", "converted", "dismissed"]
EVIDENCE_STATUSES = ["unprocessed", "processing", "linked", "needs_review", "ignored", "failed"]

# Sets of statuses that analytics count as one stage or outcome.
SHORTLISTED = ["Resume Shortlisted", "Interview Scheduled", "Interview In Progress", "Offer Negotiation", "Offer", "Joined"]
INTERVIEWED = ["Interview Scheduled", "Interview In Progress", "Offer Negotiation", "Offer", "Joined"]
OFFERED = ["Offer", "Joined"]
AUDIT_OFFERED = ["Offer Negotiation", "Offer", "Joined"]
RESPONDED = [*SHORTLISTED, "Rejected"]
ACTIVE = ["Applied", "Resume Shortlisted", "Interview Scheduled", "Interview In Progress", "Offer Negotiation"]
TERMINAL = ["Rejected", "Withdrawn"]
#: Statuses whose applications no new message is expected for.
CLOSED = ["Rejected", "Withdrawn", "Joined"]

# What a signal may change a status to, forward only.
_LATE = ["Offer Negotiation", "Offer", "Rejected"]
TRANSITIONS = {
    "Applied": ["Resume Shortlisted", "Interview Scheduled", "Interview In Progress", *_LATE],
    "Resume Shortlisted": ["Interview Scheduled", "Interview In Progress", *_LATE],
    "Interview Scheduled": ["Interview In Progress", *_LATE],
    "Interview In Progress": _LATE,
    "Offer Negotiation": ["Offer", "Withdrawn"],
    "Offer": ["Joined", "Withdrawn"],
    "Joined": [],
    "Rejected": [],
    "Withdrawn": [],
}

# Thresholds.
STALE_DAYS = 14
MIN_APPLICATIONS = 10
GREEN_RATE = 0.20
PULSE_WINDOWS = (7, 28, 90)
MATURITY_DAYS = 14
CONVERSION_MONTHS = (1, 3, 6, 12)
DATE_WINDOW_DAYS = (14, 180)
MAX_CANDIDATES = 25
MAX_MERGE = 20

# Weights of the signals between a message and a record.
WEIGHTS = {
    "same_gmail_thread": 100,
    "same_external_job_id": 100,
    "same_canonical_job_url": 90,
    "sender_linked_by_human": 60,
    "sender_linked_by_resolver": 40,
    "same_external_job_id_other_source": 25,
    "known_company_domain": 25,
    "company_exact": 35,
    "company_similar": 15,
    "role_exact": 35,
    "role_similar": 20,
    "sole_active_application_at_company": 30,
    "date_in_window": 10,
    "source_match": 5,
    "external_job_id_conflict": -100,
    "company_conflict": -60,
    "role_conflict": -45,
    "date_out_of_window": -40,
    "terminal_application_new_acknowledgement": -30,
    "job_url_differs": -20,
    "text_mismatch_in_thread": -10,
}


@dataclass(frozen=True)
class Thresholds:
    """Scores of the resolver and of duplicate suggestions; they may only be tightened,
    which the blocking of pairs relies on."""

    auto_link: int = 80
    margin: int = 25
    review: int = 40
    duplicate: int = 70

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) < f.default:
                raise ValueError(f"{f.name} may not be below {f.default}")
