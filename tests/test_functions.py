"""Row-local functions on literal cases and against small Python models."""

import random
import re
from urllib.parse import urljoin, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import citations, dates, images, markdown, markup, text, urls


def test_strip_and_words_follow_python(apply):
    values = ["  a b\t\n", " x ", "", "\x1c\x1d", "one two　three \x85 four", "\n\n"]
    assert apply(text.strip, values) == [v.strip() for v in values]
    assert apply(text.word_count, values) == [len(v.split()) for v in values]


def test_entities(apply):
    cases = {
        "a &amp; b &lt;i&gt; &quot;q&quot;": 'a & b <i> "q"',
        "&copy;&eacute;&hellip;&nbsp;&middot;": "©é…\xa0·",
        "&#8364; &#x1F600; &#65;": "€ 😀 A",
        "&am cut &bogus; & alone": "&am cut &bogus; & alone",
        "&amp;lt; once only": "&lt; once only",
        "&#55296; &#0;": "� �",
    }
    assert apply(text.decode_entities, list(cases)) == list(cases.values())


def test_token_array_covers_the_page(apply):
    pages = [
        '<p a="x>y">t</p><!-- <b> --><script>if (a<b) "</p>"</script>tail',
        "a < b <br/> <!DOCTYPE x> <p cla",
        "<!-- open", "<script>open", "", "<<>>", "<a href='it\"s'>q</a>",
    ]
    assert ["".join(t) for t in apply(markup.tokens, pages)] == pages
    first = apply(markup.tokens, pages)[0]
    assert first == ['<p a="x>y">', "t", "</p>", "<!-- <b> -->",
                     '<script>if (a<b) "</p>"</script>', "tail"]


def test_visible_text_skips_markup_and_scripts(apply):
    page = "<title>T</title><style>p{}</style><p> a <b>b</b></p><!-- c --><script>d</script>&amp;"
    assert apply(markup.visible_text, [page]) == ["T a b &"]


def test_attributes(apply):
    tags = [
        '<a href="/x?a=1&amp;b=2">', "<a HREF='/q'>", "<a href=/u>", "<a href>", "<a>",
        '<a data-x="href=no" href=yes>', '<a title="a > b" href="&quot;q&quot;">', "<a xhref=n>",
    ]
    decoded = lambda c: markup.attribute(markup.decode_tag(c), "href")
    assert apply(decoded, tags) == ["/x?a=1&b=2", "/q", "/u", "", None, "yes", '"q"', None]


def test_open_tags_ignore_lookalikes(apply):
    page = '<a x="<a>"><!--<a>--><script>"<a>"</script><A b><abbr><img>'
    assert apply(lambda c: markup.open_tags(c, "a", "img"), [page]) == [
        ['<a x="<a>">', "<A b>", "<img>"]
    ]


# --- URLs ---------------------------------------------------------------------


def test_normalise(apply):
    cases = {
        "https://h.example/a/": "https://h.example/a",
        "https://h.example/a#s": "https://h.example/a",
        "https://h.example/a?q=1": "https://h.example/a",
        "https://h.example/a;p=1": "https://h.example/a",
        "https://h.example/": "https://h.example/",
        "https://h.example": "https://h.example/",
        "HTTP://H.example:80/a//": "http://H.example:80/a",
    }
    assert apply(urls.normalise, list(cases)) == list(cases.values())


def test_resolve_like_the_standard_library(spark):
    bases = ["https://h.example/a/b/c.html?q=1", "https://h.example", "http://h.example/a/"]
    refs = [
        "", "x", "/x", "./x", "../x", "../../x", "../../../../x", "x/../y", "x/./y", "?k=2", "#f",
        "x?k#f", "//o.example/p", "https://o.example/p/../q", "mailto:a@b", ".", "..", "x//y", "x/",
    ]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    rows = df.select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    wrong = [(r.b, r.r, r.u, urljoin(r.b, r.r)) for r in rows
             if r.r and r.u != urljoin(r.b, r.r)]
    # Without a path the library keeps '?k' right behind the host; so do we.
    assert wrong == []


def test_slug(apply):
    cases = {
        "https://h.example/a/b-c.html?q=1": "h_example_a_b_c_html",
        "https://h.example/": "h_example",
        "///": "page",
        "https://h.example/" + "x" * 200: ("h_example_" + "x" * 200)[:100],
    }
    assert apply(urls.slug, list(cases)) == list(cases.values())


def test_link_filters(apply):
    hrefs = ["#a", "javascript:x", "mailto:a", "tel:1", "JavaScript:x", "", "/p", "https://x"]
    assert apply(urls.is_followable_href, hrefs) == [False] * 4 + [True] * 4
    pages = ["https://h/a.PDF", "https://h/a.pdf?x", "https://h/a.html", "https://h/a.xml/b"]
    assert apply(urls.is_page_path, pages) == [False, False, True, True]


def test_glob_matches_like_the_shell(apply):
    from fnmatch import fnmatchcase

    candidates = ["https://h/a/b", "https://h/blog/1", "https://h/b.x", "https://h/[1]", "x\ny", "a^b"]
    for pattern in ["*", "*/blog/*", "https://h/?.x", "*[ab]", "*[!ab]", "*[1]*", "[[]*", "x?y", "*[^]*",
                    "*.x", "a[b", "*[]1]*"]:
        got = apply(lambda c, p=pattern: urls.matches_glob(c, p), candidates)
        assert got == [fnmatchcase(c, pattern) for c in candidates], pattern


# --- dates --------------------------------------------------------------------


def test_date_in_text(apply):
    cases = {
        "on 2024-03-05 and 2023-01-01": "2024-03-05",
        "2024-02-30 then March 5, 2024": "2024-03-05",
        "MARCH  5 2024": "2024-03-05",
        "Sep. 7, 2020": "2020-09-07",
        "Sept 7, 2020": None,
        "5 march 2024": "2024-03-05",
        "February 30, 2024 or 3 May 2021": "2021-05-03",
        "12 Dec 2020": None,
        "no date 2024": None,
    }
    assert apply(dates.date_in_text, list(cases)) == list(cases.values())


def test_meta_date(apply):
    cases = {
        "2024-01-02T23:30:00-08:00": "2024-01-02",
        "2024-01-02T23:30:00Z": "2024-01-02",
        "2024-02-30T00:00:00": None,
        "2024-99-99": "2024-99-99",
        "2024-01-02 10:00": "2024-01-02",
        "Tue, 2 Jan 2024": None,
        "2 Jan 2024": None,
        "": None,
    }
    assert apply(dates.meta_date, list(cases)) == list(cases.values())


def test_markdown_date_looks_at_the_start_only(apply):
    assert apply(dates.date_in_markdown, ["x" * 1000 + "2024-01-01", "2024-01-01"]) == [
        None, "2024-01-01"]


def test_years_start_at_one_and_values_end_where_they_end(apply):
    assert apply(dates.date_in_text, ["0000-01-01", "0001-01-01"]) == [None, "0001-01-01"]
    values = ["2024-01-02T03:04", "2024-01-02T03:04\n", "0000-01-01T00:00"]
    assert apply(dates.meta_date, values) == ["2024-01-02", None, None]


# --- markdown repairs -----------------------------------------------------------


def heading_model(md):
    """Lines become letters (bare heading, short words, other); runs of H S+ are joined."""
    lines = md.split("\n")
    short = r"\s*(?![#*\-\[|>]|```)\S+(?:\s+\S+){0,2}\s*"
    kinds = "".join(
        "H" if re.fullmatch(r"#{1,6}\s*", x) else "S" if re.fullmatch(short, x) else "O"
        for x in lines
    )
    runs = [lines[r.start() : r.end()] for r in re.finditer("HS+|.", kinds)]
    return "\n".join(x[0] if len(x) == 1 else " ".join(y.strip() for y in x) for x in runs)


def test_heading_repair_equals_the_model(apply):
    rng = random.Random(7)
    pool = ["#", "##  ", "###### ", "#######", "word", " two words", "a b c", "a b c d", "", "- x",
            "* y", "[l](u)", "| t", "> q", "```", "## done", "``x", "  "]
    docs = ["\n".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(600)]
    assert apply(markdown.fix_heading_linebreaks, docs) == [heading_model(d) for d in docs]


def test_heading_of_many_lines_does_not_exhaust_the_stack(apply):
    out = apply(markdown.fix_heading_linebreaks, ["#\n" + "w\n" * 200_000])[0]
    assert out.startswith("# w w w") and len(out) == 400_002


def test_citation_duplication(apply):
    cases = {
        "Sign up[3]Sign up": "Sign up[3]",
        "Sign up [12] Sign up now": "Sign up[12] now",
        "See[5]Other": "See[5]Other",
        "Ab[1]Ab and Cd[2]Cd": "Ab[1] and Cd[2]",
        "results [1] show": "results[1]how",
        "no mark": "no mark",
        "x" * 61 + "[1]" + "x" * 61: "x" * 61 + "[1]",
    }
    assert apply(markdown.fix_citation_duplication, list(cases)) == list(cases.values())


def test_citation_duplication_equals_the_plain_pattern(apply):
    rng = random.Random(3)
    pattern = r"([\w][^\[\]]{0,60}?)\s*\[(\d+)\]\s*\1"
    docs = ["".join(rng.choices(["ab", "b", " ", "[1]", "[22]", "\n", "[", "]", "é", "."], k=30))
            for _ in range(400)]
    assert apply(markdown.fix_citation_duplication, docs) == [
        re.sub(pattern, r"\1[\2]", d) for d in docs]


def test_empty_links_and_images(apply):
    cases = {
        "a ![](x.png) b": "a b",
        "a [](https://h) b": "a b",
        "![alt](x.png) [t](u)": "![alt](x.png) [t](u)",
        "[![logo](i)](u)": "[![logo](i)](u)",
        "[![](i)](u) c": "c",
    }
    assert apply(markdown.strip_empty_image_links, list(cases)) == list(cases.values())


def test_clean_markdown(apply):
    md = "#\nBig\nNews\n\nJoin[5]Join\n\n![](e.png)\n\n\n\n\nText.\n\n\n"
    assert apply(markdown.clean_markdown, [md, ""]) == ["# Big News\n\nJoin[5]\n\nText.", ""]


def test_tidy_output_collapses_before_it_trims(apply):
    docs = ["A\n\n\n\n\nB", "a  \nb\t ", " \n x \n\n \n\n\n y "]
    want = ["\n".join(s.rstrip() for s in re.sub(r"\n{4,}", "\n\n\n", d).split("\n")).strip() for d in docs]
    assert apply(markdown.tidy_output, docs) == want


def test_strip_images(apply):
    assert apply(markdown.strip_images, ["a ![x](y)  b [l](u)"]) == ["a b [l](u)"]


# --- citations ------------------------------------------------------------------


def citation_model(md):
    seen = {}

    def number(m):
        if m[2].startswith("#"):
            return m[0]
        mark = f"[{seen.setdefault(m[2], len(seen) + 1)}]"
        return f"{m[1]} {mark}" if m[1].strip() else mark

    out = re.sub(r"(?<!!)\[([^\]]*)\]\(([^)]+)\)", number, md)
    refs = "".join(["\n## References\n", *[f"\n[{n}] {u}" for u, n in seen.items()]]) if seen else ""
    return out, refs


def check_citations(apply, docs):
    got = apply(citations.add_citations, docs)
    assert [(g["markdown"], g["references"]) for g in got] == [citation_model(d) for d in docs]


def test_citations_literal(apply):
    check_citations(apply, [
        "See [A](https://a) and [B](https://b), [again](https://a).",
        "![pic](https://i) [x](https://x) [s](#h) [](https://e) [ ](https://f)",
        "[![n](https://img)](https://page)", "[a](u)[b](v)", "plain", "",
    ])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(
    ["[a](u)", "![i](v)", "[", "]", "(", ")", "!", "[](w)", "[x](#h)", " ", "t", "\n", "[b](u2)"]),
    max_size=14).map("".join), min_size=1, max_size=40))
def test_citations_equal_the_model(apply, docs):
    check_citations(apply, docs)


def test_many_links_use_the_search_and_number_alike(apply):
    rng = random.Random(1)
    check_citations(apply, [" ".join(f"[t](u{rng.randint(0, 400)})" for _ in range(3000))])


def test_with_references(apply):
    both = lambda c: citations.with_references(c, F.lit("refs"))
    none = lambda c: citations.with_references(c, F.lit(""))
    assert apply(both, ["m"]) == ["m\nrefs"] and apply(none, ["m"]) == ["m"]


# --- images -----------------------------------------------------------------------


def test_image_urls(apply):
    md = "![a](https://h/i.png) ![](http://h/j) ![l](local.png) ![d](data:x) ![a](https://h/i.png)"
    assert apply(images.image_urls, [md]) == [["https://h/i.png", "http://h/j", "https://h/i.png"]]


def test_image_key_and_data_uri(apply):
    import base64
    import hashlib

    url = "https://h/i.png"
    assert apply(images.image_file_key, [url]) == [hashlib.md5(url.encode()).hexdigest()[:12] + ".jpg"]
    payload = bytes(range(256)) * 3
    uri = apply(lambda c: images.data_uri(F.lit("image/png"), c), [bytearray(payload)], "binary")[0]
    assert uri == "data:image/png;base64," + base64.b64encode(payload).decode()


@pytest.mark.parametrize("kind,size,ok", [
    ("image/png", 1, True), ("application/octet-stream", 1, True), ("text/html", 1, False),
    (None, 1, False), ("image/png", images.MAX_IMAGE_BYTES + 1, False),
])
def test_image_validity(spark, kind, size, ok):
    df = spark.range(1).select(F.lit(kind).cast("string").alias("t"),
                               F.repeat(F.lit("x"), size).cast("binary").alias("b"))
    assert df.select(images.is_usable_image(F.col("t"), F.col("b"))).first()[0] is ok


def test_url_parts(apply):
    url = "https://u@h.example:8/p;x/q;y?k=v#f"
    parts = urlsplit(url)
    assert apply(urls.scheme, [url]) == [parts.scheme]
    assert apply(urls.netloc, [url]) == [parts.netloc]
    assert apply(urls.path, [url]) == ["/p;x/q"]
    assert apply(urls.query, [url]) == [parts.query]
    assert apply(urls.fragment, [url]) == [parts.fragment]


# --- double-byte charsets ---------------------------------------------------------------

DECLARED = {"Shift_JIS": "cp932", "GB2312": "gbk", "big5": "cp950", "EUC-KR": "cp949", "x-sjis": "cp932"}


def test_every_character_of_a_double_byte_charset_comes_back(spark):
    from leafmill.sources.pages import decode_payloads

    rows = []
    for charset, codec in DECLARED.items():
        chars = [chr(c) for c in range(0x20, 0xFFE0) if not 0xD800 <= c <= 0xF8FF]
        text = "<p>" + "".join(c for c in chars if _codes(c, codec)) + "</p>"
        rows.append((charset, text, bytearray(text.encode(codec))))
    df = spark.createDataFrame(rows, "charset string, text string, body binary")
    good, bad = decode_payloads(df.withColumn("declared", F.col("charset")))
    assert bad.count() == 0
    for r in good.collect():
        assert r.html == r.text and len(r.text) > 6000, r.declared


def _codes(char, codec):
    try:
        return char.encode(codec).decode(codec) == char
    except UnicodeError:
        return False


def test_broken_double_bytes_are_set_aside(spark):
    from leafmill.sources.pages import decode_payloads

    cases = [
        ("shift_jis", "日本 abc ｱ".encode("cp932"), "日本 abc ｱ"), ("shift_jis", b"ok \x82", None),
        ("shift_jis", b"\x82\x20x", None), ("gbk", "中文€".encode("gbk", "ignore"), "中文"), ("gbk", b"\xff", None),
        ("big5", "繁體\n".encode("cp950"), "繁體\n"), ("big5", b"\xa4\x30", None), ("euc-kr", "한국어".encode("cp949"), "한국어"),
        ("euc-kr", b"\xb0", None), ("euc-kr", b"", ""), ("gb2312", None, None),
    ]
    df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(cases)], "id int, charset string, body binary")
    good, bad = decode_payloads(df)
    got = {r.id: r.html for r in good.collect()}
    assert got == {i: t for i, (_, b, t) in enumerate(cases) if t is not None or b is None}
    assert {r.reason for r in bad.collect()} == {"bytes"} and bad.count() == 5


def _by_units(body, codec, lead, trail):
    """The text unit by unit: a lead and its trail byte, else a byte; None if one is no character."""
    text, at = "", 0
    while at < len(body):
        two = re.fullmatch(lead + trail, body[at : at + 2].decode("latin-1"))
        unit = body[at : at + (2 if two else 1)]
        try:
            char = unit.decode(codec)
        except UnicodeDecodeError:
            return None
        if len(char) != 1 or 0xE000 <= ord(char) <= 0xF8FF:
            return None
        text, at = text + char, at + len(unit)
    return text


@pytest.mark.parametrize("charset", ["shift_jis", "gbk", "big5", "euc-kr"])
def test_double_bytes_are_decoded_unit_by_unit(spark, charset):
    from leafmill.functions.charsets import DOUBLE_BYTE, decode_double_byte

    rng = random.Random(7)
    codec, lead, trail = DOUBLE_BYTE[charset]
    bodies = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    sound = [b for b in bodies[128:] if _by_units(b, codec, lead, trail)]
    for _ in range(3000):
        bodies.append(b"".join(rng.choice(sound) for _ in range(rng.randrange(1, 12))))
        bodies.append(bytes(rng.choice((rng.randrange(256), 0x82, 0xB1, 0x41)) for _ in range(rng.randrange(3, 6))))
    # runs as long as a page
    bodies += [sound[-1] * 300_000, b"ab\n" * 300_000 + sound[-1], sound[0] * 300_000 + b"\xff"]
    want = [_by_units(b, codec, lead, trail) for b in bodies[:-3]]
    want += [_by_units(sound[-1], codec, lead, trail) * 300_000, "ab\n" * 300_000 + _by_units(sound[-1], codec, lead, trail), None]
    rows = [(i, bytearray(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "i int, body binary").select("i", decode_double_byte(F.col("body"), charset).alias("text"))
    got = {r.i: r.text for r in df.collect()}
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    assert sum(w is not None for w in want) > 8000 and None in want


def test_payloads_are_decoded_once(spark):
    from leafmill.sources.pages import decode_payloads

    payloads = spark.createDataFrame([(1, "gbk", bytearray(b"a"))], "id int, charset string, body binary")
    for made in decode_payloads(payloads.repartition(1)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # each charset's pattern stands once, not in a filter and a projection, nor in a test and a value
        assert plan.count("regexp_extract_all") == 4
