"""Redaction of personal data and the scan for what is left of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxboard.functions.text import (
    BOUNDARY,
    NOT_WORD_AFTER,
    NOT_WORD_BEFORE,
    bind,
    blank_to_null,
)

# Personal-data patterns and their replacement tokens.
EMAIL = rf"(?iu){BOUNDARY}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{BOUNDARY}"
MOBILE = r"(?U)(?=[+\d])(?<!\d)(?:\+?91[\s-]*)?[6-9]\d{9}(?!\d)"
PHONE = MOBILE + (
    r"|(?=[+\d])(?<!\d)\+?\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?!\d)"
)
_UUID = (
    rf"{NOT_WORD_BEFORE}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-"
    rf"[0-9a-f]{{12}}{NOT_WORD_AFTER}"
)
_NAMED_ID = rf"{NOT_WORD_BEFORE}(?:gaid|idfa|android[_-]?id)\s*[:=]\s*\S+{BOUNDARY}"
_LONG_HEX = rf"{NOT_WORD_BEFORE}[0-9a-f]{{16,}}{NOT_WORD_AFTER}"
DEVICE_ID = rf"(?iU){_UUID}|{_NAMED_ID}|{_LONG_HEX}"
DEVICE_ID_SCAN = rf"(?iU){_UUID}|{_NAMED_ID}"
HANDLE = rf"{NOT_WORD_BEFORE}@[A-Za-z][A-Za-z0-9._]{{2,}}{BOUNDARY}"
REDACTED = r"(?iu)\[(?:email|phone|device_id)\]"
EMAIL_TOKEN = "[email]"
PHONE_TOKEN = "[phone]"
DEVICE_TOKEN = "[device_id]"


def redact_pii(c: Column) -> Column:
    """Emails, then phones, then device ids replaced by tokens; blank becomes null."""
    text = F.regexp_replace(redact_emails(c), PHONE, PHONE_TOKEN)
    return blank_to_null(F.regexp_replace(text, DEVICE_ID, DEVICE_TOKEN))


def redact_emails(c: Column) -> Column:
    return F.when(c.contains("@"), F.regexp_replace(c, EMAIL, EMAIL_TOKEN)).otherwise(c)


def pii_kinds(c: Column) -> Column:
    """Kinds of personal data in a text; redaction tokens themselves are clean."""
    text = F.coalesce(c, F.lit(""))
    residual = F.when(text.contains("["), F.regexp_replace(text, REDACTED, " ")).otherwise(text)

    def kinds(t: Column) -> Column:
        at = t.contains("@")
        return F.array(
            F.when(at & t.rlike(EMAIL), F.lit("email pattern")),
            F.when(t.rlike(MOBILE), F.lit("phone pattern")),
            F.when(t.rlike(DEVICE_ID_SCAN), F.lit("device id pattern")),
            F.when(at & t.rlike(HANDLE), F.lit("username handle")),
        )

    return F.array_compact(bind(residual, kinds))
