"""Repairs of markdown produced by HTML conversion. All row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import LINE_SPACE, SPACE, interleave, let, strip

# --- fixed values -----------------------------------------------------------
EMPTY_IMAGE = rf"!\[\]\([^)]+\)[{SPACE}]*"
EMPTY_LINK = rf"(?<!!)\[\]\([^)]+\)[{SPACE}]*"
IMAGE = rf"!\[[^\]]*\]\([^)]+\)[{SPACE}]*"
BLANK_RUN = r"\n{4,}"
REPEATED_CITATION = (
    rf"([\p{{L}}\p{{N}}_][^\[\]]{{0,60}}?)[{SPACE}]*\[(\p{{Nd}}+)\][{SPACE}]*\1"
)
REPEATED_TEXT = 61
# ----------------------------------------------------------------------------

# Whitespace inside one line, and its complement.
_GAP = f"[{LINE_SPACE}]"
_WORD = f"[^{SPACE}]"

# A line of only #..###### and the short lines after it: up to three words each,
# none starting like another block.
_ORPHAN = rf"^#{{1,6}}{_GAP}*+$"
ORPHAN_HEADING = (
    rf"(?dm){_ORPHAN}"
    rf"(?:\n{_GAP}*+(?![#*\-\[|>]|```){_WORD}++(?:{_GAP}++{_WORD}++){{0,2}}+{_GAP}*+$)++"
)


def fix_heading_linebreaks(markdown: Column) -> Column:
    """Pull the words of a heading back onto its marker line."""

    def joined(m: Column) -> Column:
        return strip(F.regexp_replace(m, rf"{_GAP}*\n{_GAP}*", " "))

    return let(
        markdown,
        lambda t: F.when(
            t.rlike(rf"(?dm){_ORPHAN}"), interleave(t, ORPHAN_HEADING, joined)
        ).otherwise(t),
    )


# What the repeated text needs ahead of it: a citation mark right behind at most 61
# characters. Trying every length at every word character costs a hundred times more.
_CITATION_AHEAD = rf"(?=[^\[\]]{{1,{REPEATED_TEXT}}}+[{SPACE}]*+\[\p{{Nd}})"
_CITATION_BEFORE_WORD = rf"\[\p{{Nd}}++\][{SPACE}]*+[\p{{L}}\p{{N}}_]"


def fix_citation_duplication(markdown: Column) -> Column:
    """``text[3]text`` -> ``text[3]``."""
    pattern = _CITATION_AHEAD + REPEATED_CITATION
    return let(
        markdown,
        lambda t: F.when(
            t.rlike(_CITATION_BEFORE_WORD), F.regexp_replace(t, pattern, "$1[$2]")
        ).otherwise(t),
    )


def strip_empty_image_links(markdown: Column) -> Column:
    """Drop images without alt text, then links without text."""
    return F.regexp_replace(
        F.regexp_replace(markdown, EMPTY_IMAGE, ""), EMPTY_LINK, ""
    )


def collapse_blank_lines(markdown: Column) -> Column:
    """At most two blank lines in a row."""
    return F.regexp_replace(markdown, BLANK_RUN, "\n\n\n")


def clean_markdown(markdown: Column) -> Column:
    """All repairs, in the order structure, content, empties, blank lines."""
    repaired = fix_citation_duplication(fix_heading_linebreaks(markdown))
    return strip(collapse_blank_lines(strip_empty_image_links(repaired)))


def strip_images(markdown: Column) -> Column:
    return F.regexp_replace(markdown, IMAGE, "")


def tidy_output(markdown: Column) -> Column:
    """Blank-line limit, then no trailing space on any line, then no outer space."""
    trimmed = F.regexp_replace(
        collapse_blank_lines(markdown), rf"(?dm)(?<!{_GAP}){_GAP}++$", ""
    )
    return strip(trimmed)
