"""Enumerations and limits of the job-search model, in one place (fixed values)."""

from __future__ import annotations

STATUSES = ("applied", "in_review", "assessment", "interview", "offer", "rejected", "ghosted", "withdrawn")
EVENT_TYPES = ("applied", "response", "assessment", "interview_scheduled", "feedback", "rejection", "offer", "ghost_inferred")
RESPONSE_EVENTS = ("assessment", "feedback", "interview_scheduled", "offer", "rejection", "response")
SUCCESS_EVENTS = ("interview_scheduled", "offer")
NEGATIVE_STATUSES = ("rejected", "ghosted")
LIVE_STATUSES = ("applied", "in_review", "assessment", "interview", "offer")
GENERAL_CATEGORIES = ("recruiter_outreach", "follow_up", "other")
LIFECYCLE_CATEGORIES = ("application_confirmation", "assessment", "interview_invite", "rejection", "offer")
SOURCES = ("linkedin", "company_site", "indeed", "referral", "other")
DIMENSIONS = ("role", "source", "salary", "company_type", "industry", "sponsorship", "seniority", "work_mode", "tech")
#: Diagnostics leave out company_type and industry unless asked.
DIAGNOSTIC_DIMENSIONS = ("role", "source", "salary", "sponsorship", "seniority", "work_mode", "tech")
SILENCE_BUCKETS = (("0_7", 0, 7), ("8_14", 8, 14), ("15_30", 15, 30), ("31_60", 31, 60), ("61_plus", 61, None))

GHOST_DAYS = 30
FOLLOW_UP_DAYS = 7
ACTIVE_DAYS = 60
GROUPING_DAYS = 30
STALE_ATTEMPT_DAYS = 365
STORY_DAYS = 366
CHUNK_CHARS, CHUNK_OVERLAP = 1200, 200
VECTOR_DIMENSIONS, MAX_DISTANCE = 1536, 1.35
LIST_LIMIT, LIST_MAXIMUM = 20, 100
HIGHLIGHTS = 3
