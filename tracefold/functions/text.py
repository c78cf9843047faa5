"""Text canonicalisation, hashing and content signals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracefold.protocol import TEXT_SEPARATOR

# White space as Python's str.strip sees it: the Unicode property plus four separators.
SPACE = r"[\s\x1c-\x1f]"

# Code points that NFC never changes: every text made of these alone skips the UDF.
NFC_STABLE = (
    r"\x{0}-\x{2ff}\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205e}"
    r"\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)

# Content-signal patterns.
HTML_PATTERN = r"</?[a-z][^>]*>"
URL_PATTERN = r"(?:https?://|www\.)"
EMAIL_PATTERN = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
CODE_PATTERN = (
    r"(?:\bat\s+[\w.$]+\([^\n)]*:\d+\)|Traceback \(most recent call last\)|"
    r"Exception(?:\b|:)|\b(?:class|public|private|protected)\s+\w+|```)"
)

# White space and word borders as SQL engines see them: ASCII, without the vertical tab.
SQL_SPACE = r"[\t\n\f\r ]"
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"

# The same patterns in that reading.  Case folding adds the long s and the Kelvin sign to ASCII letters.
SQL_PATTERNS = {
    "has_html": r"(?i)</?[a-z\u017f\u212a][^>]*>",
    "has_url": r"(?i)(?:http[s\u017f]?://|www\.)",
    "has_email": rf"{_EDGE}[^\t\n\f\r @]+@[^\t\n\f\r @]+\.[^\t\n\f\r @]+{_EDGE}",
    "has_code": (
        rf"(?i)(?:{_EDGE}at{SQL_SPACE}+[\w\u017f\u212a.$]+\([^\n)]*:\d+\)"
        r"|Tracebac[k\u212a] \(mo[s\u017f]t recent call la[s\u017f]t\)"
        rf"|Exception(?:{_EDGE}|:)"
        rf"|{_EDGE}(?:cla[s\u017f][s\u017f]|public|private|protected){SQL_SPACE}+[\w\u017f\u212a]|```)"
    ),
}


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda text: text.casefold(), na_action="ignore")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """True for the empty string and for white space only; one character settles most."""
    first = F.substring(c, 1, 1)
    return (first == "") | (first.rlike(f"(?U){SPACE}") & c.rlike(rf"(?U)\A{SPACE}*\z"))


def normalize_lines(c: Column) -> Column:
    fixed = F.when(c.contains("\r"), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)
    return F.coalesce(fixed, F.lit(""))


def may_change_under_nfc(c: Column) -> Column:
    """False for every text that NFC leaves alone; cheap tests decide for most texts."""
    return (
        (F.octet_length(c) != F.length(c))
        & c.rlike(r"[^\x{0}-\x{2ff}]")
        & c.rlike(rf"[^{NFC_STABLE}]")
    )


def normalize_nfc(c: Column) -> Column:
    """NFC; only texts holding a code point that NFC could touch travel to Python."""
    return F.coalesce(_nfc(F.when(may_change_under_nfc(c), c)), c)


def canonical_text(c: Column) -> Column:
    return normalize_nfc(normalize_lines(c))


def with_canonical_text(df: DataFrame, *columns: str) -> DataFrame:
    """Canonical columns in two projections, so that no step is evaluated twice."""
    lined = df.withColumns({c: normalize_lines(F.col(c)) for c in columns})
    return lined.withColumns({c: normalize_nfc(F.col(c)) for c in columns})


def combined_text(summary: Column, description: Column) -> Column:
    return F.concat(summary, F.lit(TEXT_SEPARATOR), description)


def exact_text_hash(summary: Column, description: Column) -> Column:
    """SHA-256 of two canonical fields with a NUL byte between them."""
    joined = F.concat(
        F.encode(summary, "UTF-8"), F.unhex(F.lit("00")), F.encode(description, "UTF-8")
    )
    return F.sha2(joined, 256)


def _caseless(field: Column) -> Column:
    """Lower case with the letters that case-insensitive matching folds onto ASCII."""
    return F.lower(F.translate(field, "ſıİ", "sii"))


def _has_any(field: Column, *words: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | field.contains(word)
    return found


def _has_html(field: Column) -> Column:
    return field.contains("<") & field.rlike(f"(?iU){HTML_PATTERN}")


def _has_url(field: Column) -> Column:
    return (field.contains("://") | _caseless(field).contains("www.")) & field.rlike(
        f"(?iU){URL_PATTERN}"
    )


def _has_email(field: Column) -> Column:
    return field.contains("@") & field.rlike(f"(?U){EMAIL_PATTERN}")


def _may_have_code(field: Column) -> Column:
    words = ("traceback", "exception", "class", "public", "private", "protected", "```")
    frame = field.contains("(") & field.contains(":")
    return frame | _has_any(_caseless(field), *words)


def _has_code(field: Column) -> Column:
    return _may_have_code(field) & field.rlike(f"(?iU){CODE_PATTERN}")


def content_signals(summary: Column, description: Column) -> dict[str, Column]:
    """Signals over both fields; a substring test spares most texts the pattern."""
    tests = {
        "has_html": _has_html, "has_url": _has_url,
        "has_email": _has_email, "has_code": _has_code,
    }
    return {name: test(summary) | test(description) for name, test in tests.items()}


def sql_signals(summary: Column, description: Column) -> dict[str, Column]:
    """Signals over both fields as SQL engines read the patterns; the same tests spare most texts."""
    hints = {
        "has_html": lambda c: c.contains("<"),
        "has_url": lambda c: c.contains("://") | _caseless(c).contains("www."),
        "has_email": lambda c: c.contains("@"),
        "has_code": _may_have_code,
    }
    return {
        name: (hint(summary) & summary.rlike(SQL_PATTERNS[name]))
        | (hint(description) & description.rlike(SQL_PATTERNS[name]))
        for name, hint in hints.items()
    }


def all_blank(*fields: Column) -> Column:
    """Fully empty row: no field holds a visible character."""
    return F.forall(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), is_blank)


def text_for_view(view: Column, summary: Column, description: Column) -> Column:
    return (
        F.when(view == "SUMMARY_DESCRIPTION", combined_text(summary, description))
        .when(view == "SUMMARY_ONLY", summary)
        .when(view == "DESCRIPTION_ONLY", description)
        .otherwise(F.raise_error(F.concat(F.lit("unknown text view: "), view)))
    )


def casefold(c: Column) -> Column:
    """Full case folding (sharp s is ss, both small sigmas are one); lower() serves ASCII texts."""
    foreign = F.octet_length(c) != F.length(c)
    return F.coalesce(_folded(F.when(foreign, c)), F.lower(c))
