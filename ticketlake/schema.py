"""Schemas, class orders and other fixed values of the ticket data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order in ticket files, index records and hits.
TICKET = T.StructType(
    [
        T.StructField("ticket_id", T.StringType(), False),
        T.StructField("created_date", T.TimestampNTZType()),
        T.StructField("resolved_date", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("product_service", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("satisfaction_rating", T.DoubleType()),
        T.StructField("time_to_resolution_hours", T.DoubleType()),
    ]
)

REQUEST = T.StructType([T.StructField("description", T.StringType())])

HIT_FIELDS = ["ticket_id", "subject", "category", "sub_category", "priority", "resolution"]

METADATA_FIELDS = [
    "ticket_id",
    "category",
    "sub_category",
    "priority",
    "department",
    "status",
    "resolution",
    "subject",
    "satisfaction_rating",
]

TEXT_FIELDS = ["subject", "description", "resolution"]

# The labels of a source in a prompt.
CONTEXT_HEAD = "Ticket "
CONTEXT_LABELS = {"category": "Category", "priority": "Priority", "subject": "Subject", "resolution": "Resolution"}

# Class names, display orders and bounds of the ticket domain.
PRIORITY_ORDER = ["Critical", "High", "Medium", "Low"]
RESOLVED_STATUSES = ["Closed", "Resolved"]
OPEN_STATUSES = ["Open", "In Progress", "Pending"]
HOURS_BOUNDS = {
    "Critical": (0.5, 8.0),
    "High": (2.0, 24.0),
    "Medium": (4.0, 72.0),
    "Low": (8.0, 168.0),
}
PRIORITY_BADGES = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢"}
DEFAULT_BADGE = "⚪"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DATE_FORMAT = "yyyy-MM-dd HH:mm"
MIN_DESCRIPTION = 10
MAX_TOKENS = 128
VOCABULARY_SIZE = 10_000
MISSING_DESCRIPTION = "Missing 'description' in request body"

# Phrases that signal each priority.
URGENCY_PHRASES = {
    "Critical": [
        "This is completely blocking production — we are losing revenue every minute.",
        "The entire team is blocked and cannot work. This is a P1 emergency.",
        "Production is down. All users affected. Needs immediate escalation.",
        "This is critical — customer-facing services are unavailable right now.",
        "All work has stopped. This needs to be fixed in the next hour.",
        "We have an SLA breach in 30 minutes if this isn't resolved.",
    ],
    "High": [
        "This is blocking my work completely — I can't proceed without this fixed.",
        "I have a client deliverable due in 2 hours and this is stopping me.",
        "Multiple people on my team are affected and we're all blocked.",
        "This is time-sensitive — please treat as high priority.",
        "I've already missed one meeting because of this. Please help urgently.",
        "This is causing significant disruption to my team's work today.",
    ],
    "Medium": [
        "This is slowing me down but I can work around it for now.",
        "Not blocking me completely but I'd like this fixed today if possible.",
        "This is affecting my productivity but not a total blocker.",
        "Would appreciate a fix when you get a chance — moderately impactful.",
        "Happy to work around this short-term but it needs to be addressed.",
    ],
    "Low": [
        "No rush on this — just flagging it when you have time.",
        "This is a minor inconvenience, not urgent at all.",
        "Whenever you get a chance — low priority for me.",
        "Not urgent. Please address when convenient.",
        "This can wait — just wanted to log it so it doesn't get forgotten.",
        "Low priority — happy to wait until your schedule allows.",
    ],
}

# The prompt a generator model receives.
SYSTEM_PROMPT = """You are an expert IT support analyst. You will be given a new support ticket
and a set of similar resolved tickets from the past.

Your job is to suggest a resolution for the new ticket based on the patterns
you see in the resolved tickets. Be specific and actionable.

Structure your response exactly like this:
Root cause: <one sentence explaining the likely cause>
Suggested resolution: <step-by-step fix>
Confidence: <high / medium / low, with one sentence explaining why>"""
HUMAN_PROMPT = """Here are {n_context} similar resolved tickets from our history:

{context}

New ticket: {query}

Based on these examples, suggest a resolution for the new ticket."""
