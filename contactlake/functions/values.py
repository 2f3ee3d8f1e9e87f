"""Consent, campaign and the quality score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake import vocab
from contactlake.functions import emails, text


def consent(raw: Column) -> Column:
    """True only for a listed spelling; anything else, or nothing, is False."""
    return F.coalesce(F.lower(text.strip(raw)).isin(*vocab.CONSENT_TRUE), F.lit(False))


def campaign(raw: Column) -> Column:
    """The text as it is; empty counts as absent."""
    return F.nullif(raw, F.lit(""))


def quality_score(
    phone: Column,
    phone_unverified: Column,
    email: Column,
    email_junk: Column,
    consented: Column,
    first_name: Column,
    last_name: Column,
    campaign_id: Column,
) -> Column:
    """0 to 100 from the cleaned values; the two flag columns are booleans."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    domain = emails.domain_of(email)
    email_points = (
        F.when(email.isNull() | email_junk | domain.isin(*vocab.JUNK_EMAIL_DOMAINS), 0)
        .when(domain.isin(*vocab.FREE_DOMAINS), vocab.SCORE_EMAIL_FREE)
        .otherwise(vocab.SCORE_EMAIL_OTHER)
    )
    total = (
        points(phone.isNotNull(), vocab.SCORE_PHONE)
        + points(phone.isNotNull() & ~phone_unverified, vocab.SCORE_PHONE_VERIFIED)
        + email_points
        + points(consented, vocab.SCORE_CONSENT)
        + points(first_name.isNotNull() & last_name.isNotNull(), vocab.SCORE_FULL_NAME)
        + points(campaign_id.isNotNull(), vocab.SCORE_CAMPAIGN)
    )
    return F.least(total, F.lit(100)).cast("int")
