"""Fixed values of the contact data model.

Every word list, threshold and default below is part of the results
contract: changing one changes query output.
"""

from __future__ import annotations

# Enumerations of the canonical table.
SOURCES = ("facebook", "instagram", "google_form", "landing_page")
STATUSES = ("clean", "flagged", "duplicate")
TRANSFORMS = (
    "split_full_name",
    "first_name",
    "last_name",
    "email",
    "phone",
    "campaign_id",
    "consent",
    "created_at",
    "ignore",
)

# Cleaning word lists.
JUNK_NAMES = ("test", "n/a", "none", "null", "-")
JUNK_EMAIL_DOMAINS = ("test.com", "example.com", "example.org", "example.net", "asdf")
JUNK_EMAIL_LOCALS = ("test", "asdf", "aaa")
TYPO_DOMAINS = {
    "gmial.com": "gmail.com",
    "gamil.com": "gmail.com",
    "yaho.com": "yahoo.com",
    "hotmial.com": "hotmail.com",
    "outlok.com": "outlook.com",
}
FREE_DOMAINS = (
    "gmail.com",
    "yahoo.com",
    "hotmail.com",
    "outlook.com",
    "aol.com",
    "icloud.com",
)
SPECIAL_USE_TLDS = ("arpa", "invalid", "local", "localhost", "onion", "test")
JUNK_PHONES = ("0000000000", "1234567890", "12345", "1111111111", "5555555555")
CONSENT_TRUE = (
    "yes",
    "y",
    "true",
    "1",
    "i agree",
    "agree",
    "opt-in",
    "opted in",
    "ok",
)

# Mappings of the four known feeds, {source field: transform}.
KNOWN_MAPPINGS = {
    "facebook": {
        "full_name": "split_full_name",
        "email": "email",
        "phone_number": "phone",
        "campaign_id": "campaign_id",
        "created_time": "created_at",
    },
    "instagram": {
        "Full Name": "split_full_name",
        "E-mail": "email",
        "Phone #": "phone",
        "Campaign": "campaign_id",
        "Date Submitted": "created_at",
        "Consent?": "consent",
    },
    "google_form": {
        "Timestamp": "created_at",
        "What's your name?": "split_full_name",
        "Best number to reach you": "phone",
        "Your email address": "email",
        "How did you hear about us?": "campaign_id",
        "Do you agree to be contacted?": "consent",
    },
    "landing_page": {
        "fname": "first_name",
        "lname": "last_name",
        "email_addr": "email",
        "mobile": "phone",
        "utm_campaign": "campaign_id",
        "utm_source": "ignore",
        "opt_in": "consent",
        "submitted_at": "created_at",
        "lead_id": "ignore",
    },
}

# The feed files and the field renames of the drift injector.
FEED_FILES = {
    "facebook": "facebook_leads.jsonl",
    "instagram": "instagram_export.csv",
    "google_form": "google_form.csv",
    "landing_page": "landing_page.jsonl",
}
DRIFT_RENAMES = {"phone_number": "contact_phone", "full_name": "applicant_name"}

# Thresholds and sizes (thresholds are strict ">").
MISSING_THRESHOLD = 0.8
INVALID_THRESHOLD = 0.5
MAX_HEAL_ATTEMPTS = 3
INFERENCE_ATTEMPTS = 3
BATCH_SIZE = 5000
PROFILE_SAMPLES = 4
ERROR_SAMPLES = 5
RETRIEVAL_K = 6
NAME_SIMILARITY_MIN = 55

# Score weights.
SCORE_PHONE = 35
SCORE_PHONE_VERIFIED = 5
SCORE_EMAIL_FREE = 15
SCORE_EMAIL_OTHER = 25
SCORE_CONSENT = 20
SCORE_FULL_NAME = 10
SCORE_CAMPAIGN = 5
