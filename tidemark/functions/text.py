"""Match keys and keyword buckets as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form words that never help to tell two names apart.
LEGAL_WORDS = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "sas", "ag"]

# Sector keywords; the first sector with a hit wins.
SECTOR_KEYWORDS = {
    "software": ["software", "saas", "cloud", "data", "ai ", "artificial intelligence"],
    "healthcare": ["health", "medical", "biotech", "pharma", "therapeutic"],
    "financial": ["financ", "bank", "payment", "insur", "lending", "credit"],
    "energy": ["energy", "solar", "battery", "climate", "carbon"],
}

# Stage keywords; the first stage with a hit wins.
STAGE_KEYWORDS = {
    "seed": ["seed", "angel", "pre_seed"],
    "series_a": ["series_a", "series a"],
    "series_b": ["series_b", "series b"],
    "growth": ["series_c", "series c", "late", "growth", "private_equity"],
    "buyout": ["buyout"],
}

# The characters that count as white space at the edge of a cell.
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def _stripped(col: Column) -> Column:
    return F.trim(col, F.lit(_SPACE))


def domain_key(url: Column, strict: bool = True) -> Column:
    """Bare host of a URL, ``''`` if there is none. ``strict`` also drops the port and
    anything without a dot."""
    stops = "/?:" if strict else "/?"
    host = F.regexp_extract(F.lower(_stripped(url.cast("string"))), rf"^(?:https?://)?(?:www\.)?([^{stops}]*)", 1)
    host = _stripped(host)
    if strict:
        host = F.regexp_replace(host, "^[^.]*$", "")
    return F.coalesce(host, F.lit(""))


def name_key(name: Column) -> Column:
    """Letters and digits only, legal-form words removed, single spaces; ``''`` for NULL."""
    words = F.replace(F.lower(name.cast("string")), F.lit("&"), F.lit(" and "))
    words = F.regexp_replace(words, "[^a-z0-9]+", " ")
    words = F.regexp_replace(words, r"\b(" + "|".join(LEGAL_WORDS) + r")\b", " ")
    return F.coalesce(F.trim(F.regexp_replace(words, " +", " ")), F.lit(""))


def country_key(country: Column, missing_matches: bool = False) -> Column:
    """Lower-cased country. With ``missing_matches`` all unknown countries share the key
    ``nan`` and so match one another; otherwise they stay NULL and match nothing."""
    key = F.lower(_stripped(country.cast("string")))
    return F.coalesce(key, F.lit("nan")) if missing_matches else key


def keyword_bucket(text: Column, table: dict[str, list[str]], default: str) -> Column:
    """Name of the first bucket of ``table`` with a keyword anywhere in ``text``."""
    lowered = F.coalesce(F.lower(text), F.lit(""))
    out = None
    for bucket, words in table.items():
        hit = lowered.rlike("|".join(re.escape(w).replace(r"\ ", " ") for w in words))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return F.lit(default) if out is None else out.otherwise(default)


def sector_bucket(text: Column) -> Column:
    return keyword_bucket(text, SECTOR_KEYWORDS, "other")


def stage_bucket(stage: Column) -> Column:
    return keyword_bucket(stage, STAGE_KEYWORDS, "unknown")


def percent(col: Column, digits: int = 2, signed: bool = False) -> Column:
    """``0.298`` as ``29.80%``; NULL as empty text."""
    layout = f"%{'+' if signed else ''}.{digits}f%%"
    return F.when(col.isNull(), "").otherwise(F.format_string(layout, col * 100))


def percent_interval(low: Column, high: Column) -> Column:
    """``[+1.00%, +2.00%]``; ``--`` if there is no interval."""
    body = F.format_string("[%+.2f%%, %+.2f%%]", low * 100, high * 100)
    return F.when(low.isNull() | high.isNull(), "--").otherwise(body)
