"""Inline HTML to markdown within one block of text.

Tags become one-character marks first and markdown afterwards: a mark can be paired
by a simple regular expression, which a tag with attributes cannot. The marks are
Unicode noncharacters, which no text may interchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import markup
from leafmill.functions.text import SPACE, decode_entities, let, strip

BOLD, BOLD_END = "\ufdd0", "\ufdd1"
ITALIC, ITALIC_END = "\ufdd2", "\ufdd3"
CODE, CODE_END = "\ufdd4", "\ufdd5"
STRIKE, STRIKE_END = "\ufdd6", "\ufdd7"
LINK, LINK_TEXT, LINK_END = "\ufdd8", "\ufdd9", "\ufdda"
MARKS = "\ufdd0-\ufdda"

# --- fixed values: tag names by the markdown they give -----------------------
_PAIRS = (
    (("b", "strong"), BOLD, BOLD_END, "**"),
    (("em", "i"), ITALIC, ITALIC_END, "*"),
    (("del", "s"), STRIKE, STRIKE_END, "~~"),
    (("code", "kbd", "samp"), CODE, CODE_END, "`"),
)
# ----------------------------------------------------------------------------

_TAG_NAME = r"^<(/?[A-Za-z][^\s/>]*+)"


def _titled(target: Column, tag: Column) -> Column:
    title = markup.attribute(tag, "title")
    return F.when(
        F.coalesce(title, F.lit("")) != "",
        F.concat(target, F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')),
    ).otherwise(target)


def _link_mark(tag: Column) -> Column:
    href = F.coalesce(markup.attribute(tag, "href"), F.lit(""))
    return F.when(
        href != "", F.concat(F.lit(LINK), _titled(href, tag), F.lit(LINK_TEXT))
    ).otherwise("")


def _image(tag: Column) -> Column:
    alt = F.coalesce(markup.attribute(tag, "alt"), F.lit(""))
    src = F.coalesce(markup.attribute(tag, "src"), F.lit(""))
    return F.concat(F.lit("!["), alt, F.lit("]("), _titled(src, tag), F.lit(")"))


def _mark(tag: Column) -> Column:
    """Mark or markdown that a decoded tag stands for; '' for all other tags."""

    def by_name(name: Column) -> Column:
        out = F.when(name == "br", "\n").when(name == "/a", LINK_END)
        for names, start, end, _ in _PAIRS:
            out = out.when(name.isin(*names), start)
            out = out.when(name.isin(*[f"/{n}" for n in names]), end)
        out = out.when(name == "a", _link_mark(tag)).when(name == "img", _image(tag))
        return out.otherwise("")

    return F.when(tag == "", "").otherwise(
        let(F.lower(F.regexp_extract(tag, _TAG_NAME, 1)), by_name)
    )


def _flow_text(piece: Column, in_code: Column, escape: bool) -> Column:
    """Text node as flowing text: blank runs to one space, line breaks to one newline.

    Byte searches come first: most texts need neither of the two passes.
    """

    def holds(t: Column, *needles: str) -> Column:
        found = F.contains(t, F.lit(needles[0]))
        for needle in needles[1:]:
            found = found | F.contains(t, F.lit(needle))
        return found

    def flat(t: Column) -> Column:
        spaced = F.regexp_replace(F.translate(t, "\r\t\f", "\n  "), " {2,}", " ")
        broken = F.regexp_replace(spaced, r" ?(?:\n ?)++", "\n")
        return F.when(holds(t, "  ", "\n", "\t", "\r", "\f"), broken).otherwise(t)

    def escaped(t: Column) -> Column:
        return F.when(
            holds(t, "*", "_") & ~in_code, F.regexp_replace(t, "([*_])", r"\\$1")
        ).otherwise(t)

    return let(let(piece, flat), escaped) if escape else let(piece, flat)


def marked_text(body: Column, escape: bool = True) -> Column:
    """Inline HTML as text with marks. ``*`` and ``_`` of the text are escaped.

    ``body`` is used several times: give a column, not an expression.
    """
    in_code = rf"^<(?i:{'|'.join(_PAIRS[-1][0])})[\s/>]"

    def piece(tag: Column, text: Column) -> Column:
        flow = _flow_text(text, tag.rlike(in_code), escape)
        return F.concat(_mark(tag), F.when(text == "", "").otherwise(flow))

    def mixed(t: Column) -> Column:
        # Every text node is paired with the tag before it; the first has none.
        tags = F.regexp_extract_all(t, F.lit(markup.MARKUP), F.lit(0))
        before = F.concat(F.array(F.lit("")), F.transform(tags, markup.decode_tag))
        texts = F.transform(F.split(t, markup.MARKUP, -1), decode_entities)
        return F.array_join(F.zip_with(before, texts, piece), "")

    # Most blocks hold nothing, or text without any tag.
    plain = _flow_text(decode_entities(body), F.lit(False), escape)
    return F.when(body == "", "").otherwise(
        strip(F.when(F.contains(body, F.lit("<")), mixed(body)).otherwise(plain))
    )


def preformatted_text(body: Column) -> Column:
    """Text of a pre element: tags dropped, spacing kept."""
    text = decode_entities(F.regexp_replace(body, markup.MARKUP, ""))
    return F.regexp_replace(text, r"^\n|[\n ]++\z", "")


_ANY_MARK = f"[{MARKS}]"
_LINK_TARGET = rf"{LINK}([^{LINK_TEXT}]*+){LINK_TEXT}"


def close_emphasis(text: Column) -> Column:
    """Marks of emphasis to markdown; an element left open ends with its block."""

    def close(t: Column) -> Column:
        for _, start, end, sign in _PAIRS:
            t = F.regexp_replace(
                t,
                rf"{start}([{SPACE}]*+)([^{start}{end}]*[^{start}{end}{SPACE}])([{SPACE}]*+)"
                rf"(?:{end}|\z)",
                f"$1{sign}$2{sign}$3",
            )
        return t

    return let(text, lambda t: F.when(t.rlike(_ANY_MARK), close(t)).otherwise(t))


def close_links(text: Column) -> Column:
    """Marks of links to markdown, also around several blocks; leftovers dropped."""
    blank = rf"[{SPACE}]*+"

    def close(t: Column) -> Column:
        t = F.regexp_replace(t, rf"{_LINK_TARGET}{blank}\1{blank}{LINK_END}", "<$1>")
        t = F.regexp_replace(
            t,
            rf"{_LINK_TARGET}([{SPACE}]*+)"
            rf"([^{LINK}{LINK_END}]*[^{LINK}{LINK_END}{SPACE}])([{SPACE}]*+){LINK_END}",
            "$2[$3]($1)$4",
        )
        return F.regexp_replace(t, f"{_LINK_TARGET}|{_ANY_MARK}", "")

    return let(text, lambda t: F.when(t.rlike(_ANY_MARK), close(t)).otherwise(t))


def text_length(marked: Column) -> Column:
    """Characters a reader sees."""
    bare = F.regexp_replace(marked, f"{_LINK_TARGET}|{_ANY_MARK}", "")
    return F.when(marked.rlike(_ANY_MARK), F.length(bare)).otherwise(F.length(marked))


def link_text_length(marked: Column) -> Column:
    """Characters a reader sees inside links."""
    inside = F.regexp_extract_all(marked, F.lit(rf"{LINK_TEXT}([^{LINK_END}]*+)"), F.lit(1))
    return F.when(
        F.contains(marked, F.lit(LINK_TEXT)), F.length(F.array_join(inside, ""))
    ).otherwise(0)
