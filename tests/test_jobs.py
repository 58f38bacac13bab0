"""Jobs over small page tables, against literal expectations and brute-force models."""

import heapq
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import crawl, dedupe, links, media, metadata, ordering, redirects, tokens
from leafmill.operators.convert import to_markdown
from leafmill.plans import pages as plans
from leafmill.plans.options import Options
from leafmill.sinks import artifacts as sinks
from leafmill.sources import pages as sources

LONG = "This paragraph is long enough, with commas, to count as real content of the page. "


def page_table(spark, htmls):
    rows = [(i, f"https://h.example/p{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def convert(spark, *htmls, **options):
    out = to_markdown(page_table(spark, htmls), **options)
    return [r.markdown for r in out.orderBy("page_id").collect()]


# --- conversion -------------------------------------------------------------------


def test_blocks_and_inline(spark):
    cases = {
        "<h1>One</h1><h2>Two <b>b</b></h2><h6>Six</h6>": "# One\n\n## Two **b**\n\n###### Six",
        "<p>a  \n b</p><p>c<br>d</p>": "a\nb\n\nc\nd",
        "<p>x<strong> y </strong>z <em>e</em> <code>c_d</code> e_f</p>":
            "x **y** z *e* `c_d` e\\_f",
        '<p><a href="/u">t</a> <a href="/u" title="T">t</a> <a href="">n</a> <a>m</a></p>':
            '[t](/u) [t](/u "T") n m',
        '<a href="https://h">https://h</a>': "<https://h>",
        "<ul><li>a<ul><li>b</li></ul></li><li><p>c</p></li></ul>": "- a\n  - b\n- c",
        "<ol start=4><li>a<li>b</ol><ol><li>c</ol>": "4. a\n5. b\n\n1. c",
        "<blockquote><p>a</p><p>b</p></blockquote>": "> a\n>\n> b",
        "<pre><code>def f():\n    x_y = '*'\n</code></pre>": "```\ndef f():\n    x_y = '*'\n```",
        "<table><tr><th>A<th>B</tr><tr><td>1<td></tr></table>": "| A | B |\n| --- | --- |\n| 1 |  |",
        '<p>a</p><hr><img src="i.png" alt="x &amp; y">': "a\n\n---\n\n![x & y](i.png)",
        "<h2><div>Split</div><div>words</div></h2>": "## Split words",
        '<a href="/card"><div>Card</div></a>': "[Card](/card)",
        "<p><b>open<p>next": "**open**\n\nnext",
        "<p>a &lt;b&gt; &copy;</p>": "a <b> ©",
        "": "", "  \n ": "",
        "<script>x</script><style>y</style><!-- z -->": "",
    }
    assert convert(spark, *cases, strip_boilerplate=False) == list(cases.values())


def grid_model(rows):
    """Rows of (text, colspan, rowspan) written into a dictionary of grid places."""
    filled, width = {}, 0
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            while (y, x) in filled:
                x += 1
            for dy in range(down):
                for dx in range(across):
                    filled[y + dy, x + dx] = text if (dx, dy) == (0, 0) else ""
            x += across
    lines = []
    for y, row in enumerate(rows):
        if not row:
            continue
        # a row is as wide as what is placed in it
        width = max(x for (v, x) in filled if v == y) + 1
        lines.append("| " + " | ".join(filled.get((y, x), "") for x in range(width)) + " |")
        if len(lines) == 1:
            lines.append("|" + " --- |" * width)
    return "\n".join(lines)


def test_tables_with_spans_equal_a_grid(spark):
    rng = random.Random(9)
    pages, want = [], []
    for n in range(60):
        rows = [
            [(f"c{y}x{x}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for x in range(rng.randint(1, 4))]
            for y in range(rng.randint(1, 6))
        ]
        if n == 0:
            rows = [[(f"c{y}x{x}", 1 + (x == 1), 1 + (y % 7 == 0)) for x in range(4)] for y in range(400)]
        html = "".join(
            "<tr>" + "".join(f"<td colspan={a} rowspan='{d}'><b></b>{t}</td>" for t, a, d in row) + "</tr>" for row in rows)
        pages.append(f"<table>{html}</table>")
        want.append(grid_model(rows))
    assert convert(spark, *pages, strip_boilerplate=False) == want


def test_odd_spans(spark):
    row = "<tr><td>a<td>b</tr>"
    cases = {
        f"<table><tr><td rowspan=0>r<td>x</tr>{row}{row}</table>": "| r | x |\n| --- | --- |\n|  | a | b |\n|  | a | b |",
        "<table><tr><td colspan=-2>a<td colspan=x>b</table>": "| a | b |\n| --- | --- |",
        "<table><tr><td colspan=2><p>a</p><p>b</p></td></tr></table>": "| a b |  |\n| --- | --- |",
        f"<table><tr><td rowspan=9>r</tr></table><p>t</p><table>{row}</table>": "| r |\n| --- |\n\nt\n\n| a | b |\n| --- | --- |",
    }
    assert convert(spark, *cases, strip_boilerplate=False) == list(cases.values())


def test_every_page_gives_a_row_with_its_url(spark):
    out = to_markdown(page_table(spark, ["", "<nav>n</nav>", "<p>x</p>"])).orderBy("page_id").collect()
    assert [(r.url, r.markdown) for r in out] == [
        ("https://h.example/p0", ""), ("https://h.example/p1", ""), ("https://h.example/p2", "x")]


def test_null_html_gives_an_empty_text(spark):
    assert convert(spark, None, strip_boilerplate=False) == [""]


def test_navigation_and_footer_go_even_in_raw_mode(spark):
    page = ("<header>H</header><nav><nav>in</nav>N</nav><p>keep</p></nav>"
            "<aside>A</aside><p>this</p><footer>F")
    assert convert(spark, page, strip_boilerplate=False) == ["keep\n\nthis"]


def test_local_files_keep_their_navigation(spark):
    page = "<title>T</title><nav><ul><li><a href='/a'>a</a></ul></nav><p>b</p><footer>c</footer><script>d</script>"
    assert convert(spark, page, strip_boilerplate=False, strip_subtrees=False) == ["- [a](/a)\n\nb\n\nc"]


def test_file_names_in_place_of_slugs(spark):
    pages = page_table(spark, ["<p>a</p>"])
    name = lambda table, **o: sorted(r.slug for r in plans.run_mode(table, Options(raw=True, **o)).collect())
    assert name(pages) == ["h_example_p0"] and name(pages, filename="my page") == ["my page"]
    assert name(pages, filename="x", mode="metadata") == ["x"]
    both = name(page_table(spark, ["a", "b"]), filename="x")
    assert len(set(both)) == 2 and all(s.startswith("x_") for s in both)
    for bad in ("", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            Options(filename=bad)


def test_attribute_with_block_tags_inside(spark):
    assert convert(spark, '<div data-x="<p>no</p>"><p>yes</p></div>', strip_boilerplate=False) == ["yes"]


def test_main_content(spark):
    page = (
        "<html><body><div id=menu><p>Short</p><a href=/a>A</a></div><div class=wrap>"
        f"<div class=story><h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 2}</p></div>"
        f"<div class=comments><p>{LONG}</p></div><p>{LONG}</p></div>"
        f"<div class=promo><p><a href=/x>{LONG}</a></p></div></body></html>"
    )
    text = convert(spark, page)[0]
    assert text.startswith("# Head") and text.count("long enough") == 6
    assert "Short" not in text and "](/x)" not in text


def test_main_content_of_a_cut_page(spark):
    page = f"<body><div class=ad>Buy now</div><article><h1>T</h1><p>{LONG}</p><p>{LONG}"
    assert convert(spark, page)[0].startswith("# T") and "Buy" not in convert(spark, page)[0]


def test_page_without_paragraphs_is_kept_whole(spark):
    assert convert(spark, "<div>a</div><div>b</div>") == ["a\n\nb"]


def test_selectors_choose_before_stripping(spark):
    page = (
        "<nav><p>Menu</p></nav><article><header><h2>Title</h2><p class=by>By Ann</p></header>"
        "<p>Text body one.</p><footer><p>Foot</p></footer></article><aside><p>Side</p></aside>"
    )
    want = {
        "article header h2": "## Title", ".by": "By Ann", "aside p": "Side", "nav": "",
        "article": "Text body one.", "article, .by": "By Ann\n\nText body one.",
        "header": "", "nav p, footer": "Menu", "p:not(.by)": "Menu\n\nText body one.\n\nFoot\n\nSide",
        "article header": "",
    }
    for selector, text in want.items():
        got = convert(spark, page, strip_boilerplate=False, selector=selector)
        assert got == [text], selector
    assert convert(spark, page, selector=".by") == ["By Ann"]
    assert convert(spark, page, strip_boilerplate=False, selector="h6") == ["Text body one."]


def test_attribute_operators(spark):
    page = '<p data-x="one two">a</p><p data-x="onetwo">b</p><p id="two-x">c</p><p data-x="">d</p>'
    want = {
        "[data-x^=one]": "a\n\nb", "[data-x$='two']": "a\n\nb", '[data-x*="e t"]': "a",
        "[data-x~=two]": "a", "[data-x]": "a\n\nb\n\nd", "p:not([data-x])": "c",
        "p:not(#two-x)": "a\n\nb\n\nd", "[data-x~='']": "a\n\nb\n\nc\n\nd",
    }
    for selector, text in want.items():
        assert convert(spark, page, strip_boilerplate=False, selector=selector) == [text], selector


def test_selectors(spark):
    page = ('<div class="side x">S</div><article class="post big" id=a data-k="v 1"><h2>T</h2>'
            "<div><p class=q>P</p></div></article><p class=q>Z</p>")
    want = {
        ".post.big": "## T\n\nP", "#a p": "P", "p.q": "P\n\nZ",
        'article[data-k="v 1"] h2': "## T", ".x, h2": "S\n\n## T",
        "div div p": "S\n\n## T\n\nP\n\nZ", ".nothing": "S\n\n## T\n\nP\n\nZ",
    }
    for selector, text in want.items():
        assert convert(spark, page, strip_boilerplate=False, selector=selector) == [text], selector
    for bad in ("a >", "p:first-child", "p:nth-child(2)", ""):
        with pytest.raises(ValueError):
            convert(spark, page, selector=bad)


def test_depth_ignores_stray_closing_tags(spark):
    table = page_table(spark, ["</nav>a<nav>b<nav>c</nav>d</nav>e"])
    rows = tokens.with_depth(tokens.tokenise(table), ("nav",)).orderBy("pos").collect()
    assert [(r.raw, r.depth) for r in rows if r.kind == "text"] == [
        ("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 0)]


# --- links and metadata ---------------------------------------------------------------


def test_links(spark):
    page = (
        '<a href="/a">1</a><a href="https://h.example/b">2</a><a href="https://o.example/c">3</a>'
        '<a href="#f">4</a><a href="/a/">5</a><a href="/d.PDF">6</a><a href="mailto:x">7</a>'
        '<a href="c?x=1">8</a><a href="ftp://h.example/e">9</a><a>10</a><a href>11</a>'
    )
    rows = links.extract_links(page_table(spark, [page])).orderBy("pos").collect()
    assert [(r.pos, r.abs_url) for r in rows] == [
        (0, "https://h.example/a"), (1, "https://h.example/b"), (7, "https://h.example/c?x=1"),
        (9, "https://h.example/p0")]
    only = links.extract_links(page_table(spark, [page]), url_pattern="*/[ab]").collect()
    assert len(only) == 2


def test_metadata_record(spark):
    page = (
        '<html><head><title> Page &amp; title </title><meta name="author" content="">'
        '<meta property="author" content="Ann"><meta name=description content="D">'
        '<meta property="og:image" content="i.png"><link rel="nofollow canonical" href="/c">'
        '<meta name="pubdate" content="not a date"><meta name="sailthru.date" content="2024-05-06">'
        '</head><body><p>one two three</p><a href="/in">i</a><a href="https://x.example/">e</a>'
        '<a href="https://y.example/">e</a><a href="//y.example/q">e</a><a href="#s">s</a>'
        '<img src=a><IMG src=b><video></video><iframe></iframe><script>not words</script></body></html>'
    )
    row = metadata.extract_metadata(page_table(spark, [page, ""])).orderBy("page_id").collect()
    got = {k: v for k, v in row[0].asDict().items() if k != "page_id"}
    assert got == {
        "url": "https://h.example/p0", "title": "Page & title", "description": "D", "author": "Ann",
        "published_date": "2024-05-06", "word_count": 11, "reading_time_minutes": 1,
        "internal_link_count": 1, "external_link_count": 3,
        "top_external_domains": ["y.example", "x.example"], "image_count": 2, "video_count": 2,
        "canonical_url": "/c", "og_image": "i.png", "og_type": "", "og_site_name": "",
    }
    assert row[1].published_date is None and row[1].word_count == 0 and row[1].title == ""


def test_date_precedence(spark):
    time = '<time datetime="2024-02-02">t</time>'
    pages = [
        f'{time}<meta property="article:published_time" content="2024-01-01T23:00:00-09:00">',
        f"<time>no</time>{time} 3 March 2020", "on March 3, 2020", "x",
        '<meta name="date" content="soon"><meta name="published" content="2021-01-01">',
    ]
    rows = metadata.with_publication_date(page_table(spark, pages)).orderBy("page_id").collect()
    assert [r.published_date for r in rows] == [
        "2024-01-01", "2024-02-02", "2020-03-03", None, "2021-01-01"]


def test_reading_time_rounds_halves_to_even(apply):
    words = [0, 1, 119, 357, 595, 596, 2380]
    got = apply(metadata.reading_time, words, "bigint")
    assert got == [max(1, round(w / 238)) for w in words]


def test_top_values_equal_a_counter(apply):
    rng = random.Random(2)
    lists = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))] for _ in range(60)]
    got = apply(lambda c: metadata.top_values(c, 10), lists, "array<string>")
    assert got == [[v for v, _ in Counter(x).most_common(10)] for x in lists]


def test_metadata_json(spark):
    page = '<title>"q" é</title><a href="https://x.example">e</a>'
    records = plans.metadata_job(page_table(spark, [page]))
    text = records.first().json
    parsed = json.loads(text)
    assert list(parsed) == list(metadata.FIELDS)
    assert text == json.dumps(parsed, indent=2, ensure_ascii=False)
    assert parsed["published_date"] is None and parsed["top_external_domains"] == ["x.example"]


# --- crawl ----------------------------------------------------------------------------


def crawl_model(pages, seed, depth, max_pages):
    """Pages by their smallest path of link positions, shorter paths first.

    ``pages`` maps a path to (status, links). The order of a crawl is the order of these
    keys, so the pages are ranked by shortest path and the ranking is cut.
    """
    best = {seed: ()}
    heap = [(0, (), seed)]
    while heap:
        level, way, page = heapq.heappop(heap)
        if level == depth or best[page] != way:
            continue
        for at, link in enumerate(pages[page][1]):
            key = (level + 1, (*way, at))
            entered = link in pages and pages[link][0] < 400
            if entered and (link not in best or key < (len(best[link]), best[link])):
                best[link] = key[1]
                heapq.heappush(heap, (*key, link))
    ranked = sorted(best, key=lambda p: (len(best[p]), best[p]))
    return [(p, len(best[p])) for p in ranked[:max_pages]]


@pytest.mark.parametrize("depth,max_pages", [(3, 7), (4, 1000)])
def test_crawl_equals_the_model_on_random_graphs(spark, depth, max_pages, monkeypatch):
    # Small ranking blocks, so that a level spans several of them.
    monkeypatch.setattr(crawl, "_PARENTS_PER_GROUP", 3)
    rng = random.Random(depth)
    rows, seeds, want = [], [], {}
    for site in range(6):
        n = rng.randint(4, 25)
        graph = {
            f"/{i}": (rng.choice([200, 200, 200, 404]), [f"/{rng.randint(0, n + 2)}" for _ in range(rng.randint(0, 6))])
            for i in range(n)
        }
        for path, (status, out) in graph.items():
            html = "".join(f'<a href="{rng.choice(["", f"https://s{site}.example"])}{o}{rng.choice(["", "/", "#x"])}">l</a>'
                           for o in out)
            rows.append((len(rows), f"https://s{site}.example{path}", html, status))
        seeds.append((site, f"https://s{site}.example/0"))
        want[site] = crawl_model(graph, "/0", depth, max_pages)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, status int")
    got = crawl.deep_crawl(pages, spark.createDataFrame(seeds, "seed_id int, url string"), max_pages, depth)
    found = {}
    for r in got.orderBy("seed_id", "crawl_rank").collect():
        assert r.crawl_rank == len(found.setdefault(r.seed_id, [])) + 1
        found[r.seed_id].append((r.url.split(".example")[1], r.level))
    assert found == want


def test_levels_do_not_move_the_store(spark):
    from leafmill.session import Buckets

    rows = [(i, f"https://h.example/{i}", f"https://h.example/{i}", 200) for i in range(50)]
    index = spark.createDataFrame(rows, "page_id bigint, url string, norm_url string, status int")
    wanted = index.select("url", "norm_url").limit(20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Buckets(spark) as store:
            exact, similar = crawl.lookup_tables(index)
            tables = store.table(exact, "exact", "_url"), store.table(similar, "similar", "_norm")
            found = crawl.look_up(wanted, tables, "url", "norm_url")
            assert found.filter("page is not null").count() == 20
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Bucketed: true") == 2
            # one for the limit, one for the wanted rows at each of two joins; none above a scan
            names = [t for t in store._tables]
            lines = plan.splitlines()
            for i, line in enumerate(lines):
                if "FileScan" in line:
                    above = [x for x in lines[max(0, i - 4):i] if "Exchange" in x]
                    assert not above, plan
        assert not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_crawl_pattern_and_lookup(spark):
    rows = [
        (5, "https://h.example/", '<a href="/a?x=2">1</a><a href="/b">2</a><a href="/blog/1">3</a>'),
        (7, "https://h.example/a?x=1", ""), (3, "https://h.example/a?x=3", ""),
        (9, "https://h.example/a?x=2", ""), (2, "https://h.example/b", ""),
        (1, "https://h.example/blog/1", ""), (0, "https://o.example/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.example"), (2, "https://missing.example/")],
                                  "seed_id int, url string")
    ids = lambda df: [r.page_id for r in df.orderBy("crawl_rank").collect()]
    assert ids(crawl.deep_crawl(pages, seeds)) == [5, 9, 2, 1]
    assert ids(crawl.deep_crawl(pages, seeds, url_pattern="*/blog/*")) == [5, 1]
    no_exact = pages.filter("page_id <> 9")
    assert ids(crawl.deep_crawl(no_exact, seeds)) == [5, 3, 2, 1]
    for bad in ({"depth": 0}, {"depth": 11}, {"max_pages": 0}):
        with pytest.raises(ValueError):
            crawl.deep_crawl(pages, seeds, **bad)


def test_redirects_are_followed_to_their_end(spark):
    hops = [("https://h/0", "https://h/1"), ("https://h/1", "/2"), ("https://h/2", "3#x"), ("https://h/3#y", "https://h/4"),
            ("https://h/4", "https://o/5"), ("https://h/five", "https://h/0"), ("https://h/a", "/b"), ("https://h/b", "/c"),
            ("https://h/c", "/a"), ("https://h/d", "/a"), ("https://h/s", "/s"), ("https://h/t", "/z"), ("https://h/t", "/y"),
            (None, "/x"), ("https://h/n", None)]
    table = spark.createDataFrame(hops, "url string, to_url string")
    got = {r.url[len("https://h/"):]: (r.final_url, r.hops, r.error) for r in redirects.resolve_redirects(table).collect()}
    end, lost = "https://o/5", (None, None, "too many")
    assert got == {
        "0": (end, 5, None), "1": (end, 4, None), "2": (end, 3, None), "3": (end, 2, None), "4": (end, 1, None),
        "five": lost, "a": lost, "b": lost, "c": lost, "d": lost, "s": lost, "t": ("https://h/y", 1, None)}
    six = redirects.resolve_redirects(table, 6).filter("url = 'https://h/five'").first()
    assert (six.final_url, six.hops) == (end, 6)
    assert redirects.resolve_redirects(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        redirects.resolve_redirects(table, 0)


def test_random_redirects_equal_a_walk(spark):
    rng = random.Random(5)
    step = {f"https://h/{i}": f"https://h/{rng.randint(0, 260)}" for i in rng.sample(range(260), 200)}
    want = {}
    for url in step:
        at, n = url, 0
        while at in step and n <= 9:
            at, n = step[at], n + 1
        want[url] = (at, n) if at not in step and n <= 5 else (None, None)
    table = spark.createDataFrame(list(step.items()), "url string, to_url string").repartition(3)
    got = {r.url: (r.final_url, r.hops) for r in redirects.resolve_redirects(table).collect()}
    assert got == want and len({v for v in want.values()}) > 10


def test_crawl_through_a_chain_and_a_loop(spark):
    rows = [
        (1, "https://new.example/home", '<a href="/old1">1</a><a href="/loop">2</a><a href="/there">3</a><a href="/p#f">4</a>'),
        (2, "https://new.example/p", '<a href="/deep">d</a>'), (3, "https://new.example/there", "t"),
        (4, "https://new.example/elsewhere", "e"), (5, "https://other.example/x", f'<a href="/y">y</a><a href="https://new.example/q">q</a>'),
        (7, "https://other.example/y", "y"), (6, "https://new.example/q", "q"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    base = "https://new.example"
    seeds = spark.createDataFrame([(1, f"{base}/start"), (2, "https://old.example/")], "seed_id int, url string")
    hops = [(f"{base}/old{k}", f"/old{k + 1}") for k in (1, 2, 3, 4)] + [(f"{base}/old5", "/p")]
    hops += [(f"{base}/loop", "/loop2"), (f"{base}/loop2", "/loop"), ("https://old.example/", f"{base}/home"),
             (f"{base}/start", "/home"), (f"{base}/there", "/elsewhere"), (f"{base}/deep", "https://other.example/x")]
    table = spark.createDataFrame(hops, "url string, to_url string")
    sent = redirects.resolve_redirects(table)
    assert crawl.deep_crawl(pages, seeds, depth=2).count() == 0
    rows = crawl.deep_crawl(pages, seeds, None, 3, redirects=sent).orderBy("seed_id", "crawl_rank").collect()
    # The page under /p is asked for twice, the loop has no page, a stored address needs no hop; a
    # page of another host is entered, but of its links only those to the seed's own host count.
    assert [(r.requested_url, r.url) for r in rows if r.seed_id == 1] == [
        (f"{base}/start", f"{base}/home"), (f"{base}/old1", f"{base}/p"), (f"{base}/there", f"{base}/there"),
        (f"{base}/p#f", f"{base}/p"), (f"{base}/deep", "https://other.example/x"), (f"{base}/q", f"{base}/q")]
    assert [(r.requested_url, r.url) for r in rows if r.seed_id == 2] == [("https://old.example/", f"{base}/home")]
    assert crawl.missing_seeds(pages, seeds, sent).count() == 0 and crawl.missing_seeds(pages, seeds).count() == 2


# --- dedupe, order, limit ---------------------------------------------------------------


def test_dedupe_keeps_the_first_and_limits_on_the_map_side(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "rank int, markdown string").repartition(8)
    out = dedupe.dedupe_by_content(docs, ["rank"])
    assert sorted(r.rank for r in out.collect()) == sorted([1, *range(0, 1000, 3)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_date_order(spark):
    rows = [("a", "2024-01-01"), ("b", None), ("c", "2024-02-01"), ("d", "2024-01-01"), ("e", None)]
    df = spark.createDataFrame(rows, "url string, published_date string")
    order = lambda *a: "".join(r.url for r in ordering.sort_by_date(df, *a).collect())
    assert order() == "cdaeb"
    assert order(True, "first") == "ebcda"
    assert order(False) == "adcbe"
    assert order(False, "first") == "beadc"
    with pytest.raises(ValueError):
        order(True, "middle")
    keys = ordering.date_order()
    first = ordering.limit_results(df, keys, 2)
    assert {r.url for r in first.collect()} == {"c", "d"} and first.columns == df.columns
    assert ordering.limit_results(df, keys, 0).count() == 5
    assert ordering.limit_results(df, keys, None).count() == 5


def test_numbering_without_one_task_per_key(spark, monkeypatch):
    rows = [("hot" if i % 10 else f"k{i % 7}", (i * 7919) % 2003, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    keys = [F.col("v"), F.col("id")]
    got = {(r.k, r.id): r.n for r in ordering.numbered(df, ["k"], keys, "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, i) in enumerate(sorted((v, i) for kk, v, i in rows if kk == k), 1):
            want[k, i] = n
    assert got == want
    big = ordering.limit_per_group(df, ["k"], keys, 1500)
    assert big.filter("k = 'hot'").count() == 1500


# --- media ------------------------------------------------------------------------------


def test_embedding_and_manifest(spark):
    docs = spark.createDataFrame(
        [(1, "![a](https://h/a.png) [l](https://h/a.png) ![b](https://h/b.png) ![a](https://h/a.png)"),
         (2, "no image"), (3, "![c](https://h/c.png)")], "page_id bigint, markdown string")
    assets = spark.createDataFrame(
        [("https://h/a.png", "image/png", bytearray(b"A")), ("https://h/b.png", "text/html", bytearray(b"B")),
         ("https://h/c.png", "application/octet-stream", bytearray(b"CC"))],
        "url string, content_type string, bytes binary")
    got = {r.page_id: r.markdown for r in media.embed_images(docs, assets).collect()}
    a = "data:image/png;base64,QQ=="
    assert got == {
        1: f"![a]({a}) [l]({a}) ![b](https://h/b.png) ![a]({a})", 2: "no image",
        3: "![c](data:application/octet-stream;base64,Q0M=)"}
    existing = spark.createDataFrame([("https://h/c.png", "old.jpg", 9)], "url string, file_key string, size bigint")
    rows = {r.url: (r.size, r.is_new) for r in media.image_manifest(docs, assets, existing).collect()}
    assert rows == {"https://h/a.png": (1, True), "https://h/c.png": (9, False)}
    assert media.image_totals(media.image_manifest(docs, assets)).first() == (2, 3)


# --- sources, sinks, whole runs -------------------------------------------------------------


def test_payloads(spark):
    rows = [(1, bytearray("é".encode()), None), (2, bytearray(b"a\xffb"), "utf-8"),
            (3, bytearray(b"\xe9"), "ISO-8859-1"), (4, bytearray(b"x" * 20), None)]
    df = spark.createDataFrame(rows, "page_id int, body binary, charset string")
    good, bad = sources.decode_payloads(df)
    assert [r.html for r in good.orderBy("page_id").collect()] == ["é", "a�b", "é", "x" * 20]
    assert bad.count() == 0


def test_oversized_payload_is_set_aside(spark):
    df = spark.range(2).select(
        F.col("id").alias("page_id"),
        F.repeat(F.lit("x"), (F.lit(sources.MAX_PAGE_BYTES) + F.col("id")).cast("int")).cast("binary").alias("body"),
        F.lit(None).cast("string").alias("charset"))
    good, bad = sources.decode_payloads(df)
    assert [r.page_id for r in good.select("page_id").collect()] == [0]
    assert [tuple(r) for r in bad.select("page_id", "size").collect()] == [(1, sources.MAX_PAGE_BYTES + 1)]


def test_routing(spark):
    names = ["a.html", "https://h/x", "http://h", "ftp://h", "b.html", "https://h/saved"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    files = spark.createDataFrame([("a.html",), ("https://h/saved",)], "source string")
    got = {r.source: r.route for r in sources.route_sources(df, files).collect()}
    assert got == {"a.html": "file", "https://h/x": "url", "http://h": "url", "ftp://h": "error",
                   "b.html": "error", "https://h/saved": "file"}


def test_html_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<h1>A é</h1>", encoding="utf-8")
    (tmp_path / "sub" / "b.html").write_bytes(b"<p>b \xff</p>")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.HTM").write_text("<p>d")
    (tmp_path / "e.xhtml").write_text("<p>e</p>")
    files = sources.read_html_files(spark, str(tmp_path))
    got = {r.url.rsplit("/", 1)[1]: r.markdown
           for r in to_markdown(files, strip_boilerplate=False, key="path").collect()}
    assert got == {"a.html": "# A é", "b.html": "b �", "d.HTM": "d", "e.xhtml": "e"}


def test_status_filter(spark):
    df = spark.createDataFrame([(1, 200), (2, 404), (3, 0), (4, 500)], "page_id int, status int")
    assert sorted(r.page_id for r in sources.successful(df).collect()) == [1, 3]
    assert sources.successful(df, exempt=F.col("page_id") == 4).count() == 3


def test_unique_slugs(spark):
    rows = [(1, "https://h/a?x=1"), (2, "https://h/a?x=2"), (3, "https://h/b")]
    df = spark.createDataFrame(rows, "page_id int, url string")
    slugs = [r.slug for r in sinks.with_unique_slug(df).orderBy("page_id").collect()]
    assert len(set(slugs)) == 3 and slugs[2] == "h_b" and slugs[0].startswith("h_a_")
    assert all(len(s) == len("h_a_") + 32 for s in slugs[:2])


def test_repeated_keys_are_found_and_can_be_told_apart(spark, tmp_path):
    rows = [(1, "https://h/a", "<p>one</p><p>two</p>"), (1, "https://h/b", "<p>uno</p><p>dos</p>"),
            (2, "https://h/c", "<p>x</p>")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    pages = sources.read_pages(spark, path, row_key=True)
    assert [tuple(r) for r in sources.repeated_keys(pages).collect()] == [(1, 2)]
    assert sources.repeated_keys(pages, "row_key").count() == 0
    got = to_markdown(pages, strip_boilerplate=False, key="row_key").collect()
    assert sorted(r.markdown for r in got) == ["one\n\ntwo", "uno\n\ndos", "x"]


def test_declared_charsets(spark):
    text = "€ “q” é"
    cases = [
        ("windows-1252", text.encode("cp1252"), text), ("CP1252", b"\x80", "€"),
        ("iso8859-1", b"caf\xe9", "café"), ("ISO-8859-1", b"\x80", "\x80"),
        ("UTF-16", text.encode("utf-16"), text), ("utf-16", text.encode("utf-16-be"), text),
        ("utf_16_le", "a😀".encode("utf-16-le"), "a😀"), ("utf-16be", "a😀".encode("utf-16-be"), "a😀"),
        ("ascii", b"a\xffb", "a\ufffdb"), (None, b"a\xff", "a\ufffd"), ("", b"x", "x"),
        ("utf-16le", b"\x00\xd8", "bytes"), ("utf-16", b"\xfe\xff\x00", "bytes"),
        ("klingon", b"x", "charset"), ("utf-8", b"y" * 101, "size"), ("utf-8", None, None),
    ]
    df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(cases)],
                               "id int, charset string, body binary")
    good, bad = sources.decode_payloads(df, max_bytes=100)
    got = {r.id: r.html for r in good.collect()} | {r.id: r.reason for r in bad.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_a_shared_image_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(media, "REFS_PER_SALT", 50)
    docs = spark.range(2000).select(
        F.col("id").alias("page_id"), F.lit("![a](https://h/a.png)").alias("markdown"))
    assets = spark.createDataFrame([("https://h/a.png", "image/png", bytearray(b"A")),
                                    ("https://h/b.png", "text/html", bytearray(b"A")),
                                    ("https://h/c.png", "image/png", None)],
                                   "url string, content_type string, bytes binary")
    out = media.embed_images(docs, assets)
    assert out.filter("markdown = '![a](data:image/png;base64,QQ==)'").count() == 2000
    rejected = {r.url[-5]: r.reason for r in media.rejected_assets(assets).collect()}
    assert rejected == {"b": "type", "c": "empty"}


def test_cells_escape_the_column_mark(spark):
    page = "<table><tr><td>a|b</td><td>c</td></tr></table><p>d|e</p>"
    got = to_markdown(page_table(spark, [page]), strip_boilerplate=False).first().markdown
    assert got == "| a\\|b | c |\n| --- | --- |\n\nd|e"


def test_written_tables_read_back(spark, tmp_path):
    pages = page_table(spark, [f"<p>{LONG}</p><a href='/x'>l</a>", "<p>b</p>"]).withColumn(
        "pdf", F.when(F.col("page_id") == 0, F.lit("P").cast("binary")))
    docs = plans.run_mode(pages, Options(refs=True, raw=True))
    sinks.write_markdown(docs, str(tmp_path / "md"))
    back = spark.read.parquet(str(tmp_path / "md"))
    assert back.count() == 2 and set(back.select("netloc").distinct().first()) == {"h.example"}
    files = {r.name: r.content for r in sinks.markdown_files(docs).collect()}
    assert set(files) == {"h_example_p0.md", "h_example_p0_refs.md", "h_example_p1.md"}
    sinks.write_text_files(sinks.markdown_files(docs), str(tmp_path / "txt"))
    text = spark.read.parquet(str(tmp_path / "txt"))
    assert {r.name: r.content for r in text.collect()} == files

    archive = plans.run_mode(pages, Options(mode="archive", refs=True, raw=True))
    sinks.write_archive(archive, str(tmp_path / "arc"))
    kinds = Counter(r.artifact for r in spark.read.parquet(str(tmp_path / "arc")).collect())
    assert kinds == {"article.md": 2, "references.md": 1, "article.pdf": 1, "metadata.json": 2}
    manifest = {r.slug: r.files for r in sinks.archive_manifest(archive).collect()}
    assert manifest["h_example_p0"] == ["article.md", "references.md", "article.pdf", "metadata.json"]
    pdf = plans.run_mode(pages, Options(mode="pdf")).collect()
    assert [(r.name, bytes(r.bytes)) for r in pdf] == [("h_example_p0.pdf", b"P")]


def test_page_pipeline_options(spark):
    page = f"<p>{LONG}<a href='/x'>l</a> <img src='https://h/i.png' alt=a></p>"
    table = page_table(spark, [page])
    run = lambda **o: plans.markdown_job(table, Options(raw=True, **o)).first()
    assert "![a](https://h/i.png)" in run().markdown and run().references == ""
    assert "![a]" not in run(no_images=True).markdown
    cited = run(refs=True)
    assert "l [1]" in cited.markdown and cited.references == "\n## References\n\n[1] /x"
    assert cited.output == cited.markdown + "\n" + cited.references
    with pytest.raises(ValueError):
        run(embed_images=True)
    assert Options(embed_images=True, download_images=True).downloads is False
    for bad in ({"mode": "x"}, {"depth": 11}, {"max_pages": 0}, {"limit": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_crawl_job(spark):
    dup = f"<nav><a href='/a'>a</a><a href='/b'>b</a><a href='/c'>c</a></nav><p>{LONG}</p>"
    rows = [
        (1, "https://h.example/", dup),
        (2, "https://h.example/a", dup),
        (3, "https://h.example/b", '<meta name=date content="2024-01-01"><p>b</p>'),
        (4, "https://h.example/c", '<meta name=date content="2024-03-01"><p>c</p>'),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.example/")], "seed_id int, url string")
    ids = lambda **o: sorted(r.page_id for r in plans.crawl_job(pages, seeds, Options(**o)).collect())
    assert ids() == [1, 2, 3, 4]
    assert ids(dedupe=True) == [1, 3, 4]
    assert ids(dedupe=True, limit=2) == [1, 3]
    assert ids(sort_by_date=True, limit=2) == [3, 4]
    out = plans.crawl_and_run(pages, seeds, Options(dedupe=True, sort_by_date=True, limit=1))
    assert [r.markdown for r in out.collect()] == ["c"]


def linked_site(spark):
    """Two seeds on one host; page 2 is a copy of page 1, pages 3 and 4 are reached by both."""
    nav = "<nav>" + "".join(f"<a href='/{x}'>{x}</a>" for x in "abc") + "</nav>"
    rows = [
        (1, "https://h.example/", f"{nav}<p>{LONG}</p>"),
        (2, "https://h.example/a", f"{nav}<p>{LONG}</p>"),
        (3, "https://h.example/b", '<meta name=date content="2024-01-01"><p>b <img src="https://i/x.png" alt=x></p>'),
        (4, "https://h.example/c", '<meta name=date content="2024-03-01"><p class=k>c <a href="/q">q</a></p>'),
        (5, "https://h.example/away", "<p>never reached</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.example/"), (2, "https://h.example/a")], "seed_id int, url string")
    return pages, seeds


def test_crawl_output_has_seed_and_rank(spark):
    pages, seeds = linked_site(spark)
    options = Options(dedupe=True, sort_by_date=True, limit=2, refs=True, raw=True)
    out = plans.crawl_and_run(pages, seeds, options).collect()
    got = sorted((r.seed_id, r.crawl_rank, r.page_id, r.markdown, r.references) for r in out)
    refs = "\n## References\n\n[1] /q"
    assert got == [
        (1, 3, 3, "b ![x](https://i/x.png)", ""), (1, 4, 4, "c q [1]", refs),
        (2, 2, 3, "b ![x](https://i/x.png)", ""), (2, 3, 4, "c q [1]", refs),
    ]
    assert {r.slug for r in out} == {"h_example_b", "h_example_c"}
    chosen = plans.crawl_and_run(pages, seeds, Options(selector="p.k a", limit=4)).collect()
    assert {r.markdown for r in chosen if r.page_id == 4} == {"[q](/q)"}


def test_crawl_output_of_every_mode(spark):
    pages, seeds = linked_site(spark)
    pages = pages.withColumn("pdf", F.when(F.col("page_id") == 4, F.lit("P").cast("binary")))
    run = lambda mode: plans.crawl_and_run(pages, seeds, Options(mode=mode, raw=True)).collect()
    meta = run("metadata")
    assert {(r.seed_id, r.page_id) for r in meta} == {(s, p) for s in (1, 2) for p in (1, 2, 3, 4)} - {(2, 1)}
    assert all(json.loads(r.json)["url"] == r.url for r in meta)
    assert sorted((r.seed_id, r.crawl_rank, r.name, bytes(r.bytes)) for r in run("pdf")) == [
        (1, 4, "h_example_c.pdf", b"P"), (2, 3, "h_example_c.pdf", b"P")]
    kinds = Counter((r.seed_id, r.artifact) for r in run("archive"))
    assert kinds == {(1, "article.md"): 4, (1, "metadata.json"): 4, (1, "article.pdf"): 1,
                     (2, "article.md"): 3, (2, "metadata.json"): 3, (2, "article.pdf"): 1}


def test_crawled_pages_are_converted_once(spark):
    pages, seeds = linked_site(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    out = plans.crawl_and_run(pages, seeds, Options(dedupe=True, sort_by_date=True, limit=2, raw=True))
    # the conversion splits pages into rows; the output only reads its table
    assert "Generate" in plan(to_markdown(pages)) and "Generate" not in plan(out)


def test_figures_of_a_run_start_no_job(spark):
    pages, seeds = linked_site(spark)
    assets = spark.createDataFrame(
        [("https://i/x.png", "image/png", bytearray(b"12345")), ("https://i/y.png", "image/png", bytearray(b"1"))],
        "url string, content_type string, bytes binary")
    report = plans.RunReport()
    options = Options(dedupe=True, raw=True, embed_images=True, limit=3)
    out = plans.crawl_and_run(pages, seeds, options, assets, report)
    out.write.format("noop").mode("overwrite").save()
    context = spark.sparkContext
    context.setJobGroup("figures", "reading them")
    figures = report.figures()
    assert context.statusTracker().getJobIdsForGroup("figures") == []
    # seed 1 reaches four pages, one a copy; seed 2 reaches three
    assert figures == {"crawled": 7, "unique": 6, "processed": 6, "image_bytes": 5}


def test_few_and_many_rows_of_a_limit_agree(spark, monkeypatch):
    rows = [("hot" if i % 10 else f"k{i % 7}", (i * 7919) % 2003, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    order = [F.col("v"), F.col("id")]
    few = ordering.limit_per_group(df, ["k"], order, 40)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordering, "FEW_ROWS", 0)
    many = ordering.limit_per_group(df, ["k"], order, 40)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_metadata_of_a_stream(spark, tmp_path):
    from leafmill.streaming.feed import metadata_stream

    pages = sources.complete(page_table(spark, ["<title>A</title>", "<title>B</title>"]))
    pages.write.parquet(str(tmp_path / "feed"))
    stream = metadata_stream(spark, str(tmp_path / "feed")).writeStream.format("memory").queryName(
        "feed_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert {r.title for r in spark.table("feed_out").collect()} == {"A", "B"}


def test_checkpoint_folder_is_the_one_the_session_names(spark):
    from leafmill.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
