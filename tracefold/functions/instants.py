"""ISO-8601 timestamps with explicit handling of missing offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracefold.functions.text import strip

_DATE = r"(\d{4})-?(\d{2})-?(\d{2})"
_CLOCK = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"([+-]\d{2}(?::?\d{2})?)?)?"
_SHAPE = rf"(?s)\A{_DATE}{_CLOCK}{_OFFSET}\z"


def parse_iso(raw: Column) -> tuple[Column, Column]:
    """Return (instant in UTC or NULL, offset present).

    A text without an offset is read as UTC; impossible dates give NULL.  Two-digit
    fields are assembled into one spelling before the cast, because the cast alone
    also accepts shapes (bare years, zone names) that are not ISO-8601 instants.
    """
    text = F.regexp_replace(strip(raw), r"Z\z", "+00:00")

    def part(group: int, default: str) -> Column:
        found = F.regexp_extract(text, _SHAPE, group)
        return F.when(found == "", default).otherwise(found)

    offset = F.regexp_extract(text, _SHAPE, 8)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    zone = F.when(offset == "", "+00:00").otherwise(
        F.concat(
            offset.substr(1, 1),
            digits.substr(1, 2),
            F.lit(":"),
            F.rpad(digits.substr(3, 2), 2, "0"),
        )
    )
    spelled = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""),
        F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        F.lit("."), F.substring(part(7, "0"), 1, 6), zone,
    )
    instant = F.when(text.rlike(_SHAPE), F.try_to_timestamp(spelled))
    return instant, offset != ""


def parse_aware(raw: Column) -> Column:
    """Instant in UTC; NULL when the text is invalid or carries no offset."""
    instant, aware = parse_iso(raw)
    return F.when(aware, instant)
