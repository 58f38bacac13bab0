"""CSS selectors over a page's element tree.

Supported: element names and ``*``, ``.class``, ``#id``, ``[attr]`` with ``=``, ``^=``, ``$=``, ``*=`` and
``~=``, ``:not(...)`` of one such condition, their combinations, the descendant, child (``>``),
next-sibling (``+``) and later-sibling (``~``) combinators and comma lists, for any element,
inline ones too. Navigation, footer, header and aside are left out if they are selected
themselves or lie inside the selected element; what lies around it does not matter. Text
that several matches hold is given once.

Which tags meet which simple conditions is found out in the JVM, a bit for each step of the
selector. The bits are matched against the tree in one pass over the tags: the steps an element
meets follow from those of its parent, its ancestors, its previous sibling and all
previous siblings. Selecting needs no shuffle and its cost does not depend on the selector's shape.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import markup
from leafmill.functions.text import let
from leafmill.operators.tokens import STRIPPED_TAGS
from leafmill.operators.tree import RANK, VOID, marks, structure

_QUOTED = r"\"[^\"]*\"|'[^']*'"
_PART = re.compile(
    r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*~]?=)\s*(?P<value>{_QUOTED}|[^\]\"'\s]+)\s*)?\]"
    r"|:not\((?P<inner>[^()]+)\)"
    r"|(?P<tag>[A-Za-z][\w-]*|\*)"
)
# One step: brackets and quotes may hold blanks, commas and combinators.
_STEP = rf"(?:\[(?:{_QUOTED}|[^\]\"'])*\]|:not\((?:{_QUOTED}|[^()\"'])*\)|[^\s,>+~\[\]()])+"
_PIECE = re.compile(rf"\s*(?P<comb>[>+~,])\s*|(?P<blank>\s+)|(?P<step>{_STEP})")
_MAX_STEPS = 62

Step = tuple[str, list[dict[str, str]]]


def parse_selector(selector: str) -> list[list[Step]]:
    """Alternatives -> steps (combinator in front of it, simple conditions).

    The combinator of a first step is ''.
    """

    def refuse() -> None:
        raise ValueError(f"unsupported selector: {selector!r}")

    alternatives: list[list[Step]] = [[]]
    text, at, combinator = selector.strip(), 0, ""
    while at < len(text):
        found = _PIECE.match(text, at)
        if not found:
            refuse()
        at = found.end()
        if found["step"]:
            alternatives[-1].append((combinator, _conditions(found["step"], refuse)))
            combinator = " "
        elif found["blank"]:
            continue
        elif combinator != " ":
            refuse()  # nothing in front of a combinator, or two of them
        elif found["comb"] == ",":
            alternatives.append([])
            combinator = ""
        else:
            combinator = found["comb"]
    if combinator != " " or sum(map(len, alternatives)) > _MAX_STEPS:
        refuse()
    return alternatives


def _conditions(step: str, refuse) -> list[dict[str, str]]:
    parts, at = [], 0
    while at < len(step):
        found = _PART.match(step, at)
        if not found or (found["tag"] and at > 0):
            refuse()
        part = {k: v for k, v in found.groupdict().items() if v is not None}
        if "inner" in part and not _single(part["inner"]):
            refuse()
        parts.append(part)
        at = found.end()
    return parts


def _single(text: str) -> dict[str, str] | None:
    """The one simple condition that ``text`` is, if it is one."""
    found = _PART.fullmatch(text.strip())
    if not found or found["inner"]:
        return None
    return {k: v for k, v in found.groupdict().items() if v is not None}


def _condition(part: dict[str, str], tag: Column) -> Column:
    """Whether a decoded start tag meets one simple condition; may be null."""
    if "inner" in part:
        return ~F.coalesce(_condition(_single(part["inner"]), tag), F.lit(False))
    if "tag" in part:
        return F.lit(True) if part["tag"] == "*" else markup.tag_name(tag) == part["tag"].lower()
    if "cls" in part:
        return markup.attribute(tag, "class").rlike(rf"(?:^|\s){re.escape(part['cls'])}(?:\s|$)")
    if "id" in part:
        return markup.attribute(tag, "id") == part["id"]
    value = markup.attribute(tag, re.escape(part["attr"]))
    if "value" not in part:
        return value.isNotNull()
    wanted = part["value"].strip("\"'")
    if part["op"] == "=":
        return value == wanted
    if part["op"] == "~=":
        return F.array_contains(F.split(value, r"\s+"), wanted) & F.lit(bool(wanted))
    found = {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[part["op"]]
    return found(wanted) & F.lit(bool(wanted))


def step_bits(tokens: Column, alternatives: list[list[Step]]) -> Column:
    """For each token a number whose bits tell which steps' conditions its tag meets."""
    steps = [parts for steps in alternatives for _, parts in steps]

    def bits(tag: Column) -> Column:
        total = F.lit(0).cast("long")
        for n, parts in enumerate(steps):
            match = F.lit(True)
            for part in parts:
                match = match & F.coalesce(_condition(part, tag), F.lit(False))
            total = total + F.when(match, F.lit(1 << n).cast("long")).otherwise(0)
        return total

    return F.transform(
        tokens,
        lambda t: F.when(t.rlike("^<[A-Za-z]"), let(markup.decode_tag(t), bits)).otherwise(0),
    )


class Matcher:
    """Steps as bit masks: which bit each step needs, and where."""

    def __init__(self, alternatives: list[list[Step]]) -> None:
        self.first = self.last = 0
        self.child = self.descendant = self.next = self.later = 0
        n = 0
        for steps in alternatives:
            for k, (combinator, _) in enumerate(steps):
                bit = 1 << n
                if k == 0:
                    self.first |= bit
                elif combinator == ">":
                    self.child |= bit
                elif combinator == "+":
                    self.next |= bit
                elif combinator == "~":
                    self.later |= bit
                else:
                    self.descendant |= bit
                n += 1
            self.last |= 1 << (n - 1)

    def met(self, conditions: int, parent: int, above: int, previous: int, earlier: int) -> int:
        """Steps an element meets, given those of its parent, ancestors and siblings.

        A step needs the one in front of it, whose bit is the next lower one.
        """
        reached = (
            self.first
            | self.child & (parent << 1)
            | self.descendant & (above << 1)
            | self.next & (previous << 1)
            | self.later & (earlier << 1)
        )
        return conditions & reached


def choose(
    names: list[str], conditions: list[int], matcher: Matcher
) -> tuple[list[str | None], bool]:
    """What stands in front of each chosen token, null for the others; whether there is a match.

    A token is chosen if of the selected and the stripped elements that hold it the innermost one
    is selected. A match that is not part of another one starts on a new line, after the
    end tags that the one before it left out.
    """
    parent, end = structure(names)
    met = [0] * len(names)
    above, previous, earlier = [0] * len(names), {}, {}
    kept = [False] * len(names)
    front: list[str | None] = [None] * len(names)
    ended = {
        p for p, name in zip(parent, names, strict=True) if p >= 0 and name == "/" + names[p]
    }
    unended: list[str] = []
    in_block = matched = False
    for i, name in enumerate(names):
        p = parent[i]
        if not name or name[0] == "/":
            if p >= 0 and kept[p]:
                front[i] = ""
            continue
        over = met[p] if p >= 0 else 0
        above[i] = (above[p] if p >= 0 else 0) | over
        met[i] = own = matcher.met(
            conditions[i], over, above[i], previous.get(p, 0), earlier.get(p, 0)
        )
        previous[p] = own
        earlier[p] = earlier.get(p, 0) | own
        chosen = bool(own & matcher.last)
        matched |= chosen
        held = p >= 0 and kept[p]
        if name in STRIPPED_TAGS:
            continue
        if chosen and not held:
            front[i] = "".join(reversed(unended)) + "\n"
            unended, in_block = [], name in RANK
        elif held:
            front[i] = ""
        kept[i] = chosen or held
        # inline elements end with the block that they are in
        open_ended = i not in ended and name not in VOID and (name in RANK or not in_block)
        if kept[i] and open_ended:
            unended.append(f"</{name}>")
    return front, matched


def select_elements(pages: DataFrame, selector: str) -> DataFrame:
    """Adds ``matched``; the html of pages with a match becomes that of the matches.

    Other pages keep theirs. No shuffle: pages stay where they are.
    """
    alternatives = parse_selector(selector)
    matcher = Matcher(alternatives)

    def run(names: pa.Array, conditions: pa.Array) -> pa.Array:
        found = [
            choose(n or [], c or [], matcher)
            for n, c in zip(names.to_pylist(), conditions.to_pylist(), strict=True)
        ]
        return pa.StructArray.from_arrays(
            [pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([m for _, m in found], pa.bool_())],
            names=["front", "matched"],
        )

    chosen = F.arrow_udf(run, "struct<front: array<string>, matched: boolean>")
    tokens = pages.withColumn("_tokens", markup.tokens(F.col("html")))
    ready = tokens.withColumns(
        {"_marks": marks(F.col("_tokens")), "_bits": step_bits(F.col("_tokens"), alternatives)}
    )
    found = ready.withColumn("_found", chosen(F.col("_marks"), F.col("_bits")))
    pieces = F.zip_with(
        "_tokens", F.col("_found.front"), lambda t, f: F.when(f.isNotNull(), F.concat(f, t)).otherwise("")
    )
    matched = F.coalesce(F.col("_found.matched"), F.lit(False))
    return found.withColumns(
        {"html": F.when(matched, F.array_join(pieces, "")).otherwise(F.col("html")), "matched": matched}
    ).drop("_tokens", "_marks", "_bits", "_found")


# The functions travel with the tasks in place of this module's name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
