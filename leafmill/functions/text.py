"""String helpers shared by the other function modules.

Java regular expressions recurse once per iteration of a repeated *group*, so
every repeated group in this package is possessive (``(...)*+``): those run as a
loop and cannot exhaust the stack on a long document.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as str.strip() and str.split() of Python see it, to be put inside
# a character class. Single control characters plus one category: Java tests those
# with one bit lookup and one type lookup; ranges or the (?U) flag cost far more.
LINE_SPACE = r"\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
SPACE = r"\n" + LINE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A lambda variable is evaluated once per row, whereas a repeated Column
    expression inside a higher-order function is evaluated at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPACE_CHARS = [chr(n) for n in range(0x3001) if chr(n).isspace()]


def strip(c: Column) -> Column:
    """Drop Unicode whitespace at both ends."""

    def trimmed(t: Column) -> Column:
        # Most texts need nothing: look at two characters before running the pattern.
        loose = F.left(t, F.lit(1)).isin(_SPACE_CHARS) | F.right(t, F.lit(1)).isin(_SPACE_CHARS)
        bare = F.regexp_replace(t, rf"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z", "")
        return F.when(loose, bare).otherwise(t)

    return let(c, trimmed)


def is_blank(c: Column) -> Column:
    """Null, empty or only whitespace."""
    return c.isNull() | ~c.rlike(rf"[^{SPACE}]")


def non_empty(c: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(c, F.lit(""))


def first_of(*cols: Column) -> Column:
    """First non-empty value, else the empty string."""
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+")).cast("bigint")


def interleave(
    text: Column,
    pattern: str,
    render: Callable[[Column], Column],
    gap: Callable[[Column], Column] = lambda g: g,
) -> Column:
    """Rebuild ``text`` with every match of ``pattern`` passed through ``render``.

    The regex engine of ``regexp_replace`` cannot call a function per match; this
    splits the text once, extracts the matches once and zips them back together.
    ``pattern`` must not match the empty string.
    """
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(
            gaps,
            matches,
            lambda g, m: F.concat(
                gap(g), F.when(m.isNull(), F.lit("")).otherwise(render(m))
            ),
        ),
        "",
    )


# Character references: decimal, hexadecimal or named, semicolon optional.
ENTITY = r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*+);?"


def _named_entities() -> Column:
    """HTML5 entity names (standard library table) as a map keyed by first letter.

    ``from_json`` over a literal is folded to a map literal when the plan is
    optimised. Spark looks map keys up linearly, so two small steps beat one big one.
    """
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _code_point(n: Column) -> Column:
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    safe = F.when(valid, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def resolve_reference(m: Column) -> Column:
    """Text of one character reference; itself when the name is unknown."""
    name = F.substr(m, F.lit(2))
    number = F.regexp_replace(m, "[^0-9a-fA-F]", "")
    return (
        F.when(m.isin("&amp;", "&amp"), "&")
        .when(m.isin("&lt;", "&lt"), "<")
        .when(m.isin("&gt;", "&gt"), ">")
        .when(m.isin("&quot;", "&quot"), '"')
        .when(m.isin("&nbsp;", "&nbsp"), " ")
        .when(m.rlike("^&#[xX]"), _code_point(F.conv(number, 16, 10).cast("bigint")))
        .when(m.startswith("&#"), _code_point(number.cast("bigint")))
        .otherwise(
            F.coalesce(
                F.element_at(
                    F.element_at(_named_entities(), F.substring(name, 1, 1)), name
                ),
                m,
            )
        )
    )


def decode_entities(c: Column) -> Column:
    """Resolve HTML character references; unknown ones are left as written."""
    return F.when(F.contains(c, F.lit("&")), interleave(c, ENTITY, resolve_reference)).otherwise(c)
