"""Publication dates as ISO text (``yyyy-MM-dd``), null when none is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, let

# --- fixed values -----------------------------------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
DATE_META_KEYS = (
    "date", "published", "datePublished", "article:published_time",
    "og:article:published_time", "pubdate", "publish_date", "DC.date.issued",
    "sailthru.date",
)
TEXT_PREFIX = 1000
# ----------------------------------------------------------------------------

_FULL = "|".join(MONTHS)
_SHORT = "|".join(m[:3] for m in MONTHS)
_ISO = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_MONTH_FIRST = (
    rf"(?i)((?:{_FULL}|{_SHORT})[a-z]*)\.?[{SPACE}]+([0-9]{{1,2}}),?[{SPACE}]+([0-9]{{4}})"
)
_DAY_FIRST = rf"(?i)([0-9]{{1,2}})[{SPACE}]+({_FULL})[{SPACE}]+([0-9]{{4}})"
_OFFSET = r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2}(?:\.[0-9]+)?)?)?)?"
_TIME = (
    r"(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
)
_ISO_TIMESTAMP = rf"^{_ISO}T{_TIME}{_OFFSET}\z"


def _valid(iso: Column) -> Column:
    """Zero-padded ISO text of a ``y-m-d`` text, null when no such day exists.

    Years start at 1. Values are bound, not repeated: the code of a few dates together
    would else grow beyond what a method may hold.
    """
    day = let(iso, lambda i: F.try_to_date(F.nullif(i, F.lit(""))).cast("string"))
    return let(day, lambda d: F.when(~d.startswith("0000-"), d))


def _from_parts(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    def date(parts: Column) -> Column:
        word = parts["month"]
        number = F.greatest(
            F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word),
            F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), word),
        )
        # An unknown month name gives month 0, which is no valid date.
        return F.when(
            word != "", F.concat_ws("-", parts["year"], number.cast("string"), parts["day"])
        )

    parts = F.struct(
        F.regexp_extract(text, pattern, year).alias("year"),
        F.lower(F.regexp_extract(text, pattern, month)).alias("month"),
        F.regexp_extract(text, pattern, day).alias("day"),
    )
    return _valid(let(parts, date))


def date_in_text(text: Column) -> Column:
    """First date written as ISO, then ``Month d, yyyy``, then ``d Month yyyy``.

    Only the first match of each form is looked at.
    """
    found = F.coalesce(
        _valid(F.regexp_extract(text, _ISO, 1)),
        _from_parts(text, _MONTH_FIRST, year=3, month=1, day=2),
        _from_parts(text, _DAY_FIRST, year=3, month=2, day=1),
    )
    # Every form holds a four-digit year: most texts stop at this cheap test.
    return F.when(text.rlike("[0-9]{4}"), found)


def date_in_markdown(markdown: Column) -> Column:
    return date_in_text(F.left(markdown, F.lit(TEXT_PREFIX)))


def meta_date(value: Column) -> Column:
    """Date of a metadata value.

    A timestamp gives the day in its own offset (never shifted to the session time
    zone). Without a ``T`` the leading ``dddd-dd-dd`` is taken as it stands.
    """
    leading = F.left(value, F.lit(10))
    return F.when(
        F.contains(value, F.lit("T")),
        F.when(value.rlike(_ISO_TIMESTAMP), _valid(leading)),
    ).when(value.rlike(f"^{_ISO}"), leading)
