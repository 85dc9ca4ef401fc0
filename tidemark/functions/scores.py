"""Composite scores and evidence flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.nulls import clip, log1p_clip, zero_if_null


def sponsor_score(matched: Column, investors: Column) -> Column:
    return matched + 0.25 * F.log1p(zero_if_null(investors))


def profile_completeness(has_site: Column, has_text: Column, log_categories: Column, founders_missing: Column) -> Column:
    return (
        clip(zero_if_null(has_site), 0.0, 1.0)
        + clip(zero_if_null(has_text), 0.0, 1.0)
        + log_categories
        + (1 - founders_missing)
    )


def tier_flag(tier: Column, words: str) -> Column:
    """1 if the confidence tier mentions one of ``words`` (a regex alternation)."""
    return F.coalesce(F.lower(tier).rlike(words), F.lit(False)).cast("int")


def match_quality(score: Column, high: Column, accepted: Column, low: Column) -> Column:
    return clip(score, low=0.0) + high + accepted - low


# Wording that counts as evidence for or against a live homepage.
LIVE_STATUS = "found|success|active|archived|ok|present"
DEAD_STATUS = "missing|fail|error|inactive|not_found|not found|timeout|blocked"
STRONG_EVIDENCE = "strong|medium"
HARMLESS_FAILURE = "none|ok"


def homepage_active(status: Column, strength: Column, failure: Column, http: Column) -> Column:
    """1 if the HTTP code, the status text or the evidence strength says the page was live.

    Missing text takes part as ``nan``, as an unreadable cell of a text table does.
    """
    status, strength, failure = (
        F.coalesce(F.lower(c.cast("string")), F.lit("nan")) for c in (status, strength, failure)
    )
    code = http.try_cast("double")
    by_code = F.coalesce(code.between(200, 399), F.lit(False))
    by_status = status.rlike(LIVE_STATUS) & ~status.rlike(DEAD_STATUS)
    failed = (failure != "") & (failure != "nan") & ~failure.rlike(HARMLESS_FAILURE)
    return (by_code | by_status | (strength.rlike(STRONG_EVIDENCE) & ~failed)).cast("int")


def evidence_strength(mimetype: Column) -> Column:
    html = F.lower(F.coalesce(mimetype, F.lit(""))).startswith("text/html")
    return F.when(html, "strong").otherwise("medium")


def noise_placebo(*key: Column, seed: int = 42) -> Column:
    """Seeded standard normal that only the row's key decides."""
    from tidemark.functions.hashing import gaussian, key_digest

    return gaussian(key_digest(*key, seed))
