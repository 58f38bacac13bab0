"""The element tree and selectors on it, against a linked tree built by other means."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import selector as sel
from leafmill.operators import tree
from leafmill.operators.convert import to_markdown

BLOCKS = {"p": 1, "h1": 1, "h2": 1, "li": 1, "dd": 1, "dt": 1, "div": 2, "ul": 2, "ol": 2, "dl": 2,
          "article": 2, "nav": 2, "td": 3, "th": 3, "tr": 4, "tbody": 5, "table": 6}
NAMES = [*BLOCKS, "b", "i", "span", "a", "br", "img"]


class Node:
    def __init__(self, name, at, up):
        self.name, self.at, self.up, self.end = name, at, up, None

    def line(self):
        node = self
        while node.up is not None:
            yield node
            node = node.up


def nearest(top, wanted, stops):
    """The furthest of the wanted open elements that no stop comes before."""
    best = None
    for node in top.line():
        if node.name in stops:
            break
        if node.name in wanted:
            best = node
    return best


def model(marks):
    """Parents and ends by a chain of nodes: the innermost open one, its parent, and so on."""
    root = Node("", -1, None)
    top, parent, nodes = root, [], {}

    def leave(node, at):
        nonlocal top
        while True:
            top.end = at
            done, top = top is node, top.up
            if done:
                return

    for i, mark in enumerate(marks):
        if mark.startswith("/"):
            name, hit = mark[1:], None
            for node in top.line():
                if node.name == name:
                    hit = node
                    break
                if BLOCKS.get(node.name, 0) > BLOCKS.get(name, 0):
                    break
            parent.append(hit.at if hit else top.at)
            if hit:
                leave(hit, i)
                hit.end = i + 1
            continue
        if mark in ("td", "th"):
            hit = nearest(top, {"td", "th"}, {"tr", "table"})
        elif mark == "tr":
            hit = nearest(top, {"tr", "td", "th"}, {"table"})
        elif mark == "tbody":
            hit = nearest(top, {"tbody", "tr", "td", "th"}, {"table"})
        elif mark == "li":
            hit = nearest(top, {"li", "p"}, {"ul", "ol", "table"})
        elif mark in ("dd", "dt"):
            hit = nearest(top, {"dd", "dt", "p"}, {"dl", "table"})
        elif mark in ("h1", "h2"):
            hit = nearest(top, {"h1", "h2", "p"}, {"div", "article", "ul", "ol", "li", "dd", "td", "th", "table"})
        elif BLOCKS.get(mark):
            hit = nearest(top, {"p"}, {"td", "th", "table", "li", "dd", "div", "article"})
        else:
            hit = None
        if hit:
            leave(hit, i)
        parent.append(top.at)
        if mark:
            node = nodes[i] = Node(mark, i, top)
            if mark in ("br", "img"):
                node.end = i + 1
            else:
                top = node
    while top is not root:
        leave(top, len(marks))
    return parent, [nodes[i].end if i in nodes else None for i in range(len(marks))]


def some_marks(draw, n):
    return [
        draw.choice(["", "/", "", "/"][draw.randint(0, 1) : 2]) + draw.choice(NAMES)
        if draw.random() < 0.8 else ""
        for _ in range(n)
    ]


def as_html(marks):
    return "".join(f"<{m}>" if m else f"t{i} " for i, m in enumerate(marks))


def test_random_malformed_pages_equal_a_chain_of_nodes(spark):
    draw = random.Random(11)
    pages = []
    for _ in range(500):
        marks = some_marks(draw, draw.randint(0, 80))
        # neighbouring texts are one token
        pages.append([m for i, m in enumerate(marks) if m or i == 0 or marks[i - 1]])
    assert all(tree.structure(m) == model(m) for m in pages)
    rows = [(i, as_html(m)) for i, m in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {}
    for r in tree.tree_tokens(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.parent, r.end))
    for i, marks in enumerate(pages):
        assert got.get(i, []) == list(zip(*model(marks), strict=True))


def test_implied_ends_and_ignored_end_tags():
    def shape(html):
        names = html.split()
        parent, _ = tree.structure(names)
        return [names[p] if p >= 0 else "" for p in parent]

    assert shape("p b p") == ["", "p", ""]
    assert shape("ul li b li") == ["", "ul", "li", "ul"]
    assert shape("b div /b i") == ["", "b", "div", "div"]
    assert shape("div p /div p") == ["", "div", "div", ""]
    assert shape("table tr td table tr td /table td") == ["", "table", "tr", "td", "table", "tr", "table", "tr"]
    assert shape("h1 div h2") == ["", "h1", "div"] and shape("h1 h2") == ["", ""]
    assert shape("/x br b") == ["", "", ""]


def test_very_deep_and_very_long_pages_end():
    deep = ["b"] * 5000 + ["/i"] * 5000
    parent, end = tree.structure(deep)
    assert max(parent) == tree.MAX_DEPTH - 1 and end[0] == len(deep) and end[4000] == 4001
    assert tree.structure([]) == ([], [])


def test_pages_without_tokens_or_html(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b"), (4, "x<!-- <p> --><script><p></script>")], "page_id long, html string")
    rows = tree.tree_tokens(df).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.kind, r.parent, r.end) for r in rows] == [
        (3, "cut", -1, None), (4, "text", -1, None), (4, "comment", -1, None), (4, "raw", -1, None)]


def naive_select(marks, attrs, selector):
    """Every element against every step, right to left, on the parents alone."""
    parent, _ = tree.structure(marks)
    tags = [i for i, m in enumerate(marks) if m and m[0] != "/"]

    def fits(i, parts):
        return all(
            p.get("tag", "*") in ("*", marks[i]) and p.get("cls", attrs[i]) == attrs[i] for p in parts
        )

    def met(i, steps):
        combinator, parts = steps[-1]
        if not fits(i, parts):
            return False
        if len(steps) == 1:
            return True
        before = [j for j in tags if parent[j] == parent[i] and j < i]
        up, chain = parent[i], []
        while up >= 0:
            chain.append(up)
            up = parent[up]
        pool = {" ": chain, ">": chain[:1], "+": before[-1:], "~": before}[combinator]
        return any(met(j, steps[:-1]) for j in pool)

    return {i for i in tags if any(met(i, steps) for steps in sel.parse_selector(selector))}


SELECTORS = [
    "p", "div p", "div > p", "li + li", "h1 ~ p", "div > b ~ i", "ul li > a + b", ".x", "p.x, li.x > b",
    "article * + p", "div div div", "* > *", "td + td b, ol > li ~ li", "div.x ~ div p + p",
]


@pytest.mark.parametrize("selector", SELECTORS)
def test_random_selections_equal_a_naive_matcher(selector):
    draw = random.Random(selector)
    alternatives = sel.parse_selector(selector)
    matcher = sel.Matcher(alternatives)
    steps = [parts for steps in alternatives for _, parts in steps]
    for _ in range(60):
        marks = [m for m in some_marks(draw, 40) if m.strip("/") != "nav"]
        attrs = [draw.choice("xy") for _ in marks]
        bits = [
            sum(
                1 << n
                for n, parts in enumerate(steps)
                if all(p.get("tag", "*") in ("*", m) and p.get("cls", a) == a for p in parts)
            )
            for m, a in zip(marks, attrs, strict=True)
        ]
        want = naive_select(marks, attrs, selector)
        front, matched = sel.choose(marks, bits, matcher)
        parent, _ = tree.structure(marks)
        inside = []
        for i in range(len(marks)):
            j, found = i, False
            while j >= 0:
                found |= j in want
                j = parent[j]
            inside.append(found)
        assert [f is not None for f in front] == inside and matched == bool(want)


def convert(spark, html, selector, **options):
    df = spark.createDataFrame([(0, "https://h.example/", html)], "page_id long, url string, html string")
    return to_markdown(df, selector=selector, strip_boilerplate=False, **options).first().markdown


def test_inline_elements_children_and_siblings(spark):
    page = (
        '<div><p>one <a class="x" href="/a">A</a> two <span id=s>S <b>bold</b></span></p><p>three</p>'
        '<img src="i.png" alt="I"><ul><li>a<li class=y>b <i>c</i></ul></div><p data-k="a, > b">four'
    )
    want = {
        "a.x": "[A](/a)", "span": "S **bold**", "p > a, #s > b": "[A](/a)\n**bold**",
        "div > p + p": "three", "p ~ img": "![I](i.png)", "li.y > i": "*c*", "li + li": "- b *c*",
        "div + p": "four", "[data-k='a, > b']": "four", "div>p+p ,img": "three\n\n![I](i.png)",
        "p:not([data-k]) + p": "three",
    }
    for selector, text in want.items():
        assert convert(spark, page, selector) == text, selector


def test_unclosed_matches_do_not_run_into_the_next(spark):
    page = "<p class=x>a <b>b<p class=x>c</p><p>no</p><div class=x><i>d</div>e<span class=x>f</span>"
    assert convert(spark, page, ".x") == "a **b**\n\nc\n\n*d*\n\nf"


def test_unsupported_selectors():
    for bad in ("", " ", "a >", "> a", "a > > b", "a,", ",a", "p:first-child", "a[", "a]", "p:not(b:not(c))", "a b{"):
        with pytest.raises(ValueError):
            sel.parse_selector(bad)
    assert len(sel.parse_selector("a , b>c")) == 2
