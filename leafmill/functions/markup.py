"""HTML lexical grammar as regular expressions, and attribute access on a tag.

The grammar knows comments, declarations, script/style elements (whose content is
not markup) and tags with quoted attributes. All patterns start with a literal
``<``, so a scan skips over text quickly, and none needs to backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import (
    ENTITY,
    decode_entities,
    interleave,
    resolve_reference,
    strip,
)

# Attribute part of a tag: a '>' inside a quoted value does not end the tag.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""

COMMENT = r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"


def _raw_element(tag: str) -> str:
    return rf"<(?i:{tag})(?=[\s/>]){ATTRS}>(?:[^<]++|<(?!/(?i:{tag})))*+(?:<[^>]*+>|\z)"


RAW = rf"{_raw_element('script')}|{_raw_element('style')}"
# The second form catches a tag with an unclosed quote and a tag cut by end of page.
ANY_TAG = rf"</?[A-Za-z]{ATTRS}>|</?[A-Za-z][^>]*+(?:>|\z)"
DECLARATION = r"<[!?][^>]*+(?:>|\z)"
SKIPPED = rf"{COMMENT}|{RAW}"


def at_bracket(alternatives: str) -> str:
    """Alternatives that all start with '<': a scan steps over text in one test."""
    return f"(?=<)(?:{alternatives})"


MARKUP = at_bracket(rf"{SKIPPED}|{ANY_TAG}|{DECLARATION}")
TOKEN = rf"[^<]++|{MARKUP}|<"


def tokens(html: Column) -> Column:
    """The page as an array of lexical tokens in document order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    return (
        F.when(~token.startswith("<"), "text")
        .when(token.startswith("<!--"), "comment")
        .when(token.rlike(r"^<(?i:script|style)[\s/>]"), "raw")
        .when(token.rlike(r"^<[!?]"), "decl")
        .when(token.rlike(r"^</?[A-Za-z][\s\S]*>\z"), "tag")
        .when(token.rlike(r"^</?[A-Za-z]"), "cut")
        .otherwise("text")
    )


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*+)", 1))


# A character reference may stand for a delimiter. Until the attribute has been cut
# out of its tag, such characters are held as Unicode noncharacters.
_DELIMITERS = "\"'>"
_HELD = "\ufddc\ufddd\ufdde"


def decode_tag(tag: Column) -> Column:
    """Tag with its character references resolved, still safe to take apart."""

    def hold(m: Column) -> Column:
        return F.translate(resolve_reference(m), _DELIMITERS, _HELD)

    return F.when(F.contains(tag, F.lit("&")), interleave(tag, ENTITY, hold)).otherwise(tag)


def open_tags(html: Column, *names: str, with_title: bool = False) -> Column:
    """Opening tags with one of the given names, decoded, in document order.

    Group 1 is filled only for the wanted tags; everything else that starts with
    '<' is consumed so that look-alikes in comments, scripts and attribute values
    are not picked up. ``with_title`` adds each title element with its text.
    """
    wanted = rf"<(?i:{'|'.join(names)})(?=[\s/>]){ATTRS}>"
    if with_title:
        wanted += rf"|<(?i:title)(?=[\s/>]){ATTRS}>[\s\S]*?(?:</(?i:title)[^>]*+>|\z)"
    found = F.regexp_extract_all(
        html, F.lit(at_bracket(rf"{SKIPPED}|({wanted})|{ANY_TAG}|{DECLARATION}")), F.lit(1)
    )
    return F.transform(F.filter(found, lambda t: t != ""), decode_tag)


def named(tags: Column, *names: str) -> Column:
    """The tags with one of the given names."""
    return F.filter(tags, lambda t: t.rlike(rf"^<(?i:{'|'.join(names)})[\s/>]"))


def _release(c: Column) -> Column:
    return F.translate(c, _HELD, _DELIMITERS)


def title_text(tags: Column) -> Column:
    """Stripped text of the first title in ``open_tags(..., with_title=True)``, else ''."""
    element = first_value(named(tags, "title"))
    inner = F.regexp_replace(element, rf"^<(?i:title){ATTRS}>|</(?i:title)[^>]*+>\z", "")
    return F.coalesce(strip(_release(inner)), F.lit(""))


def _attribute_pattern(name: str) -> str:
    # Skips the attributes before the wanted one, so a look-alike inside another
    # attribute's value does not count. Group 1: the attribute as written.
    value = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)"""
    skip = rf"(?:[\s/]++(?!(?i:{name})[\s=/>])[^\s=/>]++(?:{value})?+)*+"
    return (
        rf"^<[A-Za-z][^\s/>]*+{skip}[\s/]++((?i:{name})(?=[\s=/>])(?:{value})?+)"
    )


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_attribute_pattern(name))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a decoded tag: '' if it has none, null if absent."""
    written = first_value(
        F.regexp_extract_all(tag, F.lit(_attribute_pattern(name)), F.lit(1))
    )
    return _release(
        F.regexp_replace(written, r"""^[^=]*+(?:=\s*+["']?+)?+|["']$""", "")
    )


def text_pieces(html: Column) -> Column:
    """Stripped, decoded, non-empty text nodes in document order."""
    pieces = F.filter(F.split(html, MARKUP, -1), lambda t: t != "")
    return F.filter(
        F.transform(pieces, lambda t: strip(decode_entities(t))), lambda t: t != ""
    )


def visible_text(html: Column) -> Column:
    """Text nodes joined by single spaces; script, style and comments excluded."""
    return F.array_join(text_pieces(html), " ")


def first_value(values: Column) -> Column:
    """First array element, null for an empty array."""
    return F.get(values, F.lit(0))
