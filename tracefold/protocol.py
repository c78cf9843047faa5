"""Label schemes, raw schema and study constants."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

# The raw issue table, in file order.
RAW_COLUMNS = (
    "Issue URL", "ID", "Alias", "Classification", "Component", "Product", "Version",
    "Platform", "Op sys", "Status", "Resolution", "Depends on", "Dupe of", "Blocks",
    "Groups", "Flags", "Severity", "Priority", "Deadline", "Target Milestone", "Creator",
    "Creator Detail", "Creation time", "Assigned to", "Assigned to detail", "CC",
    "CC detail", "Is CC accessible", "Is confirmed", "Is open", "Is creator accessible",
    "Summary", "Description", "URL", "Whiteboard", "Keywords", "See also",
    "Last change time", "QA contact", "History/Activity Log", "Comments", "Attachments",
)

# Columns each reader cannot do without, and names that mark relations.
AUDIT_REQUIRED = ("ID", "Severity", "Summary", "Description", "Creation time")
PREPARE_REQUIRED = AUDIT_REQUIRED + ("Dupe of",)
RELATION_TERMS = ("dupe", "depend", "block", "see also")
DELIMITERS = (",", ";", "\t", "|")

# Text joiner, window sizes, guards and tolerances of the study.
TEXT_SEPARATOR = "\n\n"
CHUNK_LENGTH = 382
CHUNK_STEP = 318
PRECISION_FLOOR = 0.30
NORM_TOLERANCE = 2e-4
STUDY_SEED = 20260809
ID_LENGTH = 20

FAMILIES = ("within_project", "pooled")
ROLES = ("TRAIN", "VALIDATION")

# The typed row every later stage reads.
PROCESSED_SCHEMA = T.StructType(
    [
        T.StructField("source_project", T.StringType()),
        T.StructField("issue_id", T.StringType()),
        T.StructField("creation_time", T.TimestampType()),
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text_combined", T.StringType()),
        T.StructField("severity_raw", T.StringType()),
        T.StructField("target_s6", T.StringType()),
        T.StructField("target_s3", T.StringType()),
        T.StructField("target_s2", T.StringType()),
        T.StructField("dupe_of", T.StringType()),
        T.StructField("exact_text_hash", T.StringType()),
        T.StructField("source_relative_path", T.StringType()),
        T.StructField("source_record_number", T.LongType()),
    ]
)


@dataclass(frozen=True)
class LabelScheme:
    """One raw label mapped to several granularities, each with a fixed class order."""

    targets: Mapping[str, Mapping[str, str]]
    orders: Mapping[str, tuple[str, ...]]
    excluded: tuple[str, ...]

    @property
    def tasks(self) -> tuple[str, ...]:
        return tuple(self.targets)

    @property
    def accepted(self) -> tuple[str, ...]:
        return tuple(next(iter(self.targets.values())))

    def fingerprint(self) -> str:
        payload = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(payload.encode()).hexdigest()

    def problems(self) -> list[str]:
        """Mapping completeness: every task covers the same labels and orders every class."""
        found = []
        for task, mapping in self.targets.items():
            if set(mapping) != set(self.accepted):
                found.append(f"{task}: mapping does not cover the accepted labels")
            if set(mapping.values()) != set(self.orders.get(task, ())):
                found.append(f"{task}: class order does not list every class")
            if len(set(self.orders.get(task, ()))) != len(self.orders.get(task, ())):
                found.append(f"{task}: class order repeats a class")
        if set(self.accepted) & set(self.excluded):
            found.append("a label is both accepted and excluded")
        return found


def _grouped(groups: Mapping[str, tuple[str, ...]]) -> dict[str, str]:
    return {raw: name for name, members in groups.items() for raw in members}


# The severity labels and their two coarser readings.
_SEVERITIES = ("blocker", "critical", "major", "normal", "minor", "trivial")
SEVERITY = LabelScheme(
    targets={
        "S6": {name: name for name in _SEVERITIES},
        "S3": _grouped(
            {
                "HIGH": ("blocker", "critical", "major"),
                "MEDIUM": ("normal",),
                "LOW": ("minor", "trivial"),
            }
        ),
        "S2": _grouped(
            {
                "HIGH_IMPACT": ("blocker", "critical", "major"),
                "LOWER_IMPACT": ("normal", "minor", "trivial"),
            }
        ),
    },
    orders={
        "S6": _SEVERITIES,
        "S3": ("HIGH", "MEDIUM", "LOW"),
        "S2": ("HIGH_IMPACT", "LOWER_IMPACT"),
    },
    excluded=("enhancement",),
)

# The same shape over order priorities, for structured rows without text.
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
PRIORITY = LabelScheme(
    targets={
        "S4": {name: name for name in _PRIORITIES},
        "S3": _grouped(
            {"HIGH": ("1-URGENT", "2-HIGH"), "MEDIUM": ("3-MEDIUM",), "LOW": ("5-LOW",)}
        ),
        "S2": _grouped(
            {
                "HIGH_IMPACT": ("1-URGENT", "2-HIGH"),
                "LOWER_IMPACT": ("3-MEDIUM", "5-LOW"),
            }
        ),
    },
    orders={
        "S4": _PRIORITIES,
        "S3": ("HIGH", "MEDIUM", "LOW"),
        "S2": ("HIGH_IMPACT", "LOWER_IMPACT"),
    },
    excluded=("4-NOT SPECIFIED",),
)


class IntegrityError(RuntimeError):
    """A data rule was violated; the message lists the failing rows."""


class LockedDataError(PermissionError):
    """Held-out data was requested without the unlock token."""
