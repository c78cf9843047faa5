"""Identity: stable ids, sort keys, duplicate references, hash ranks, experiment ids."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

from tracefold.functions.text import is_blank
from tracefold.protocol import ID_LENGTH

# How a duplicate link names its target.
BARE_ID_PATTERN = r"(?U)\A\s*(\d+)\s*\z"
LINK_ID_PATTERN = r"(?iU)(?:[?&](?:id|bug_id)=|show_bug\.cgi\?id=)(\d+)"


def stable_id(project: Column, issue: Column) -> Column:
    return F.concat(project, F.lit(":"), issue)


def issue_sort_columns(issue: Column) -> list[Column]:
    """Decimal ids first by value, the others after them by text.

    Digit strings of any length compare by (length, text) once leading zeros are
    gone, so no numeric cast can overflow.
    """
    decimal = (issue != "") & (F.translate(issue, "0123456789", "") == "")
    bare = F.when(decimal, F.ltrim(issue, F.lit("0"))).otherwise("")
    return [F.when(decimal, 0).otherwise(1), F.length(bare), bare, issue]


def duplicate_reference(raw: Column) -> Column:
    """NULL: no link; '': unreadable or naming several issues; else the target id."""
    value = F.coalesce(raw, F.lit(""))
    bare = F.regexp_extract(value, BARE_ID_PATTERN, 1)
    linked = F.array_distinct(F.regexp_extract_all(value, F.lit(LINK_ID_PATTERN), F.lit(1)))
    return (
        F.when(is_blank(value), F.lit(None).cast("string"))
        .when(bare != "", bare)
        .when(F.size(linked) == 1, F.get(linked, F.lit(0)))
        .otherwise("")
    )


def hash_rank(seed: str, key: Column) -> Column:
    """First eight bytes of SHA-256(seed|key); hex order equals unsigned order."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key), 256).substr(1, 16)


def experiment_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256).substr(1, ID_LENGTH)


def experiment_key(*parts: object) -> str:
    """Driver-side twin of :func:`experiment_id` for one configuration."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:ID_LENGTH]


def provenance_digest(provenance: Column) -> Column:
    """SHA-256 of a struct's compact JSON; the caller lists the fields in sorted order."""
    return F.sha2(F.to_json(provenance, {"ignoreNullFields": "false"}), 256)


def provenance_key(provenance: dict) -> str:
    payload = json.dumps(provenance, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(payload.encode()).hexdigest()
