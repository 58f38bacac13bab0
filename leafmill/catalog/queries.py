"""Registered queries, one per operator, keyed by the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.catalog import inputs
from leafmill.functions import citations as c
from leafmill.functions import dates, images, markup, urls
from leafmill.functions import markdown as m
from leafmill.functions.text import is_blank, word_count
from leafmill.operators import crawl, dedupe, links, media, metadata, ordering, redirects, tokens, tree
from leafmill.operators.convert import to_markdown
from leafmill.plans import pages as plans
from leafmill.plans.options import Options
from leafmill.session import run_folder
from leafmill.sinks import artifacts as sinks
from leafmill.sinks import files
from leafmill.sources import pages as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _long(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines compare the same types."""
    ints = {f.name for f in df.schema if f.dataType.simpleString() in ("int", "smallint")}
    return df.select(*[F.col(n).cast("bigint") if n in ints else F.col(n) for n in df.columns])


# --- sources ------------------------------------------------------------------


@query("SRC1")
def page_scan(spark, sf):
    return sources.complete(inputs.pages(spark, sf)).select(
        "page_id", "url", F.length("html").alias("html_chars"), "status",
        F.col("screenshot").isNull().alias("no_screenshot"),
    )


@query("SRC2")
def html_file_conversion(spark, sf):
    """The file route: pages as HTML files, read back, decoded and converted whole, without repair."""
    html = inputs.pages(spark, sf).select(
        F.concat(F.col("page_id"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")
    )
    folder = f"{run_folder(spark)}/html"
    run = files.write_files(html, folder)
    found = sources.read_html_files(spark, folder, run)
    number = F.regexp_extract("path", r"/(\d+)\.html\z", 1).cast("bigint")
    whole = to_markdown(found, strip_boilerplate=False, key="path", strip_subtrees=False)
    return whole.select(
        number.alias("page_id"), "markdown"
    )


@query("SRC3")
def source_routing(spark, sf):
    p = inputs.pages(spark, sf)
    i = F.col("page_id")
    name = (
        F.when(i % 4 == 0, F.concat(F.lit("page-"), i, F.lit(".html")))
        .when(i % 4 == 1, F.concat(F.lit("ftp://"), urls.netloc(F.col("url"))))
        .otherwise(F.col("url"))
    )
    # Every eighth page exists as a file; one of those is named like a web address.
    files = p.filter(i % 8 == 0).select(name.alias("source")).union(
        p.filter(i == 2).select(F.col("url").alias("source"))
    )
    return sources.route_sources(p.select("page_id", name.alias("source")), files).select(
        "page_id", "source", "route"
    )


@query("SRC4")
def payload_decoding(spark, sf):
    """Whole pages in seven charsets, one of them unknown, some broken, some too long."""
    i = F.col("page_id")
    utf8 = F.encode("html", "UTF-8")
    # the pages' letters are all in ISO-8859-1
    latin = F.encode("html", "ISO-8859-1")
    cases = [
        (None, F.concat(utf8, F.unhex(F.lit("FF")))),
        ("latin1", latin),
        ("Windows-1252", F.concat(latin, F.unhex(F.lit("809394")))),
        ("UTF-16", F.encode("html", "UTF-16")),
        ("us_ascii", utf8),
        ("utf-16le", F.concat(F.encode("html", "UTF-16LE"), F.unhex(F.lit("00")))),
        ("x-unknown", utf8),
    ]
    body, charset = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for n, (name, payload) in enumerate(cases):
        body = F.when(i % 7 == n, payload).otherwise(body)
        charset = F.when(i % 7 == n, F.lit(name)).otherwise(charset)
    payloads = inputs.pages(spark, sf).select(
        "page_id", body.alias("body"), charset.alias("charset")
    )
    good, bad = sources.decode_payloads(payloads, max_bytes=30_000)
    none = F.lit(None).cast("string")
    return good.select("page_id", "html", none.alias("reason")).unionAll(
        bad.select("page_id", none, "reason")
    )


@query("SRC4_double_byte")
def double_byte_decoding(spark, sf):
    """Whole pages in four double-byte charsets, their other letters as one character, some cut."""
    i = F.col("page_id")
    parts = F.split("html", r"[^\x00-\x7F]", -1)
    body = charset = None
    for n, (name, pair) in enumerate(inputs.DAY.items()):
        hexed = F.array_join(F.transform(parts, lambda t: F.hex(F.encode(t, "UTF-8"))), pair)
        body = hexed if body is None else F.when(i % 4 == n, hexed).otherwise(body)
        charset = F.lit(name) if charset is None else F.when(i % 4 == n, name).otherwise(charset)
    cut = F.when(i % 5 == 4, F.concat(body, F.lit("B0"))).otherwise(body)
    payloads = inputs.pages(spark, sf).select(
        "page_id", F.unhex(cut).alias("body"), charset.alias("charset")
    )
    good, bad = sources.decode_payloads(payloads)
    none = F.lit(None).cast("string")
    return good.select("page_id", "html", none.alias("reason")).unionAll(
        bad.select("page_id", none, "reason")
    )


@query("SRC5")
def status_filter(spark, sf):
    site = inputs.site_pages(spark, sf)
    bad_seed = site.withColumn(
        "status", F.when(F.col("url").endswith("/p/0"), 500).otherwise(F.col("status"))
    )
    kept = sources.successful(bad_seed, exempt=F.col("url").endswith("/p/0"))
    return kept.select("page_id", "url", "status")


# --- sinks --------------------------------------------------------------------


def _cited_docs(spark, sf):
    docs = inputs.md_docs(spark, sf)
    slugs = sinks.with_unique_slug(docs.select("doc_id", "url")).select("doc_id", "slug")
    return plans.cited(docs, refs=True).join(slugs, "doc_id")


@query("SNK1")
def markdown_sink(spark, sf):
    """Real files of all documents, read back by the listing of their run."""
    made = sinks.markdown_files(_cited_docs(spark, sf)).filter(~F.col("name").endswith("_refs.md"))
    folder = f"{run_folder(spark)}/markdown"
    run = files.write_files(made, folder)
    return files.read_files(spark, folder, run).select(
        "name", F.decode("content", "UTF-8").alias("content")
    )


@query("SNK2")
def references_sink(spark, sf):
    docs = _cited_docs(spark, sf)
    none = docs.withColumn(
        "references", F.when(F.col("doc_id") % 2 == 0, F.col("references")).otherwise("")
    )
    return sinks.markdown_files(none).filter(F.col("name").endswith("_refs.md"))


@query("SNK3")
def concatenated_output(spark, sf):
    docs = _cited_docs(spark, sf)
    some = F.when(F.col("doc_id") % 2 == 0, F.col("references")).otherwise("")
    return docs.select("doc_id", c.with_references(F.col("markdown"), some).alias("output"))


@query("SNK4")
def metadata_json_sink(spark, sf):
    pages = inputs.meta_pages(spark, sf)
    return sinks.metadata_files(plans.with_slug(plans.metadata_job(pages), pages))


def _archive(spark, sf):
    i = F.col("doc_id")
    docs = _cited_docs(spark, sf).select(
        "slug",
        "markdown",
        F.when(i % 2 == 0, F.col("references")).otherwise("").alias("references"),
        F.when(i % 3 == 0, F.encode(F.concat(F.lit("png"), i), "UTF-8")).alias("screenshot"),
        F.when(i % 5 == 0, F.encode(F.concat(F.lit("pdf"), i), "UTF-8")).alias("pdf"),
        F.when(i % 7 == 0, F.concat(F.lit('{"id": '), i, F.lit("}"))).alias("json"),
    )
    return sinks.archive_artifacts(docs)


@query("SNK5")
def archive_sink(spark, sf):
    return _archive(spark, sf).select(
        "slug", "artifact", "ord", "text", F.hex("bytes").alias("bytes_hex")
    )


@query("SNK6")
def pdf_passthrough(spark, sf):
    docs = inputs.documents(spark, sf)
    i = F.col("doc_id")
    pages = docs.select(
        F.concat(F.lit("doc_"), i).alias("slug"),
        F.encode("text", "UTF-8").alias("pdf"),
        F.when(i % 3 == 0, F.encode("text", "UTF-8")).alias("screenshot"),
    )
    files = sinks.payload_files(pages, "pdf", ".pdf").unionAll(
        sinks.payload_files(pages, "screenshot", ".png")
    )
    return files.select("name", F.decode("bytes", "UTF-8").alias("content"))


@query("SNK7")
def output_modes(spark, sf):
    """Every row of every mode with the checksum of its content."""
    p = sources.complete(inputs.pages(spark, sf)).withColumn(
        "pdf", F.when(F.col("page_id") % 2 == 0, F.encode("url", "UTF-8"))
    )
    run = lambda mode: plans.run_mode(p, Options(mode=mode, raw=True))
    name = F.concat("slug", F.lit(".md"))
    made = {
        "markdown": run("markdown").select("page_id", name.alias("name"), F.col("output").cast("binary").alias("content")),
        "metadata": run("metadata").select("page_id", sinks.metadata_name().alias("name"), F.col("json").cast("binary")),
        "archive": sinks.archive_files(run("archive"), keep=("page_id",)),
        "screenshot": run("screenshot"),
        "pdf": run("pdf"),
    }
    out = None
    for mode, rows in made.items():
        rows = rows.toDF("page_id", "name", "content").select(
            F.lit(mode).alias("mode"), "page_id", "name", F.octet_length("content").alias("size"),
            F.md5("content").alias("md5"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


# --- filters ------------------------------------------------------------------


@query("FLT1")
def blank_page_guard(spark, sf):
    blank = F.col("page_id") % 10 == 0
    p = inputs.pages(spark, sf).withColumn("html", F.when(blank, " \n ").otherwise(F.col("html")))
    return to_markdown(p, strip_boilerplate=False).select(
        "page_id", (F.col("markdown") == "").alias("is_empty"), is_blank(F.col("markdown")).alias("is_blank")
    )


def _site_links(spark, sf):
    return links.all_links(inputs.site_pages(spark, sf))


@query("FLT2")
def href_prefix_filter(spark, sf):
    return _site_links(spark, sf).filter(urls.is_followable_href(F.col("href"))).select(
        "page_id", "pos", "href"
    )


def _resolved(spark, sf):
    return _site_links(spark, sf).withColumn("abs_url", urls.resolve(F.col("url"), F.col("href")))


@query("FLT3")
def same_host_filter(spark, sf):
    same = urls.netloc(F.col("abs_url")) == urls.netloc(F.col("url"))
    return _resolved(spark, sf).filter(same).select("page_id", "pos", "abs_url")


@query("FLT4")
def scheme_filter(spark, sf):
    return _resolved(spark, sf).filter(urls.is_page_scheme(F.col("abs_url"))).select(
        "page_id", "pos", "abs_url"
    )


@query("FLT5")
def extension_filter(spark, sf):
    return _resolved(spark, sf).filter(urls.is_page_path(F.col("abs_url"))).select(
        "page_id", "pos", "abs_url"
    )


@query("FLT6")
def url_glob_filter(spark, sf):
    return _resolved(spark, sf).filter(
        urls.matches_glob(F.col("abs_url"), "https://s[0-4].*/p/?[!0-3]*")
    ).select("page_id", "pos", "abs_url")


@query("FLT7")
def web_image_filter(spark, sf):
    found = images.image_urls(F.col("markdown"))
    return inputs.md_docs(spark, sf).select("doc_id", F.posexplode(found).alias("pos", "image_url"))


@query("FLT8")
def image_asset_filter(spark, sf):
    return media.usable_assets(inputs.image_assets(spark, sf)).select(
        "url", "content_type", F.octet_length("bytes").alias("size")
    )


@query("FLT9")
def image_stripping(spark, sf):
    return inputs.md_docs(spark, sf).select("doc_id", m.strip_images(F.col("markdown")).alias("markdown"))


@query("FLT10")
def subtree_removal(spark, sf):
    kept = tree.drop_stripped(tree.tree_tokens(inputs.pages(spark, sf)))
    return kept.select("page_id", "pos", "kind", "tag", "raw")


@query("FLT11")
def selector_projection(spark, sf):
    """Child, descendant, next- and later-sibling steps, a class, an attribute, inline elements."""
    selector = "article > h1, h1 + p, .ad ~ article p + p + p, nav li > a[href^='/t']"
    return to_markdown(inputs.pages(spark, sf), strip_boilerplate=False, selector=selector).select(
        "page_id", "markdown"
    )


@query("FLT12")
def anchor_exemption(spark, sf):
    docs = inputs.documents(spark, sf).select(
        "doc_id", F.concat(F.col("text"), F.lit("\n[top](#h) [x](https://x.example)")).alias("markdown")
    )
    return docs.select("doc_id", c.add_citations(F.col("markdown"))["markdown"].alias("markdown"))


# --- joins --------------------------------------------------------------------


def _edges(spark, sf):
    site = inputs.site_pages(spark, sf)
    return site, links.extract_links(site)


@query("JN1")
def links_to_stored_pages(spark, sf):
    site, edges = _edges(spark, sf)
    found = crawl.look_up(
        edges, crawl.lookup_tables(crawl.page_index(site)), "abs_url", "norm_url"
    )
    return found.filter(F.col("page").isNotNull()).select(
        "page_id", "pos", F.col("page.page_id").alias("target_id"), F.col("page.url").alias("target_url")
    )


@query("JN1_redirects")
def links_through_redirects(spark, sf):
    """Links of a site whose pages have moved up to seven times, and where they end."""
    site, edges = _edges(spark, sf)
    sent = redirects.resolve_redirects(inputs.moves(site))
    tables = crawl.lookup_tables(crawl.page_index(inputs.moved(site)), sent)
    found = crawl.look_up(edges, tables, "abs_url", "norm_url")
    return found.select(
        "page_id", "pos", "abs_url", F.col("page.page_id").alias("target_id"), F.col("page.url").alias("final_url")
    )


@query("JN2")
def links_not_stored(spark, sf):
    site, edges = _edges(spark, sf)
    stored = site.select(urls.normalise(F.col("url")).alias("norm_url"))
    return edges.join(stored, "norm_url", "left_anti").select("page_id", "norm_url")


@query("JN3")
def refs_to_payloads(spark, sf):
    refs = media.image_refs(inputs.md_docs(spark, sf), "doc_id")
    usable = media.usable_assets(inputs.image_assets(spark, sf)).select("url", "content_type")
    return media.join_payloads(refs, usable, "doc_id").select("doc_id", "pos", "url", "content_type")


@query("JN4")
def link_numbers(spark, sf):
    docs = inputs.md_docs(spark, sf).select(
        "doc_id", c.link_urls(F.col("markdown")).alias("all"), c.cited_urls(F.col("markdown")).alias("urls")
    )
    return docs.select("doc_id", "urls", F.posexplode("all").alias("pos", "url")).select(
        "doc_id", "pos", "url", F.array_position("urls", F.col("url")).alias("n")
    )


@query("JN5")
def element_containment(spark, sf):
    """Tokens inside an article, by interval containment; their paragraphs and children."""
    rows = tree.tree_tokens(inputs.pages(spark, sf))
    article = F.col("tag") == "article"
    inside = tree.with_inside(rows, article, "inside").filter("inside")
    opens = (F.col("tag") == "p") & ~F.col("is_close")
    starts = rows.filter(article & ~F.col("is_close")).select(
        "page_id", F.col("pos").alias("parent"), F.lit(True).alias("is_child")
    )
    return inside.join(starts, ["page_id", "parent"], "left").groupBy("page_id").agg(
        F.count_if(opens).alias("paragraphs"),
        F.count_if(opens & F.col("is_child")).alias("child_paragraphs"),
    )


# --- aggregations ---------------------------------------------------------------


@query("AGG1")
def words_per_page(spark, sf):
    return inputs.pages(spark, sf).select(
        "page_id", word_count(markup.visible_text(F.col("html"))).alias("word_count")
    )


@query("AGG2")
def reading_times(spark, sf):
    words = word_count(F.col("text"))
    return inputs.documents(spark, sf).select(
        "doc_id", metadata.reading_time(words).alias("minutes")
    )


@query("AGG3")
def link_counts(spark, sf):
    return metadata.extract_metadata(inputs.site_pages(spark, sf)).select(
        "page_id", F.col("internal_link_count").alias("internal_links"),
        F.col("external_link_count").alias("external_links"),
    )


def _domains(spark, sf, k):
    hrefs = F.transform(links.page_hrefs(F.col("html")), lambda a: urls.netloc(a["href"]))
    external = F.filter(hrefs, lambda n: (n != "") & (n != urls.netloc(F.col("url"))))
    return inputs.site_pages(spark, sf).select(
        "page_id", F.array_join(metadata.top_values(external, k), " ").alias("domains")
    )


@query("AGG4")
def top_domains(spark, sf):
    return _domains(spark, sf, metadata.TOP_DOMAINS)


@query("AGG5")
def media_counts(spark, sf):
    tags = markup.open_tags(F.col("html"), "img", "video", "iframe")
    return inputs.meta_pages(spark, sf).select("page_id", tags.alias("tags")).select(
        "page_id",
        F.size(markup.named(F.col("tags"), "img")).alias("images"),
        F.size(markup.named(F.col("tags"), "video", "iframe")).alias("videos"),
    )


@query("AGG6")
def first_meta_values(spark, sf):
    tags = inputs.meta_pages(spark, sf).select(
        "page_id", metadata.meta_entries(markup.open_tags(F.col("html"), "meta")).alias("entries")
    )
    keys = ["author", "og:title", "date"]
    return tags.select("page_id", metadata.meta_values(F.col("entries"), keys).alias("v")).select(
        "page_id",
        *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("author", "og_title", "date"))],
    )


@query("AGG7")
def first_elements(spark, sf):
    tags = inputs.meta_pages(spark, sf).select(
        "page_id", markup.open_tags(F.col("html"), "link", "time", with_title=True).alias("tags")
    )
    return tags.select(
        "page_id",
        markup.title_text(F.col("tags")).alias("title"),
        metadata.canonical_href(F.col("tags")).alias("canonical_url"),
        metadata.first_time(F.col("tags")).alias("time"),
    )


@query("AGG8")
def fallback_chains(spark, sf):
    return metadata.extract_metadata(inputs.meta_pages(spark, sf)).select(
        "page_id", "title", "description", "author", "og_image", "og_type", "og_site_name"
    )


@query("AGG9")
def distinct_links(spark, sf):
    _, edges = _edges(spark, sf)
    return edges.select("page_id", "pos", "abs_url", "norm_url")


@query("AGG10")
def content_dedupe(spark, sf):
    docs = inputs.documents(spark, sf).select("doc_id", F.col("text").alias("markdown"))
    return dedupe.dedupe_by_content(docs, ["doc_id"]).select("doc_id")


@query("AGG11")
def ordered_assembly(spark, sf):
    rows = tokens.tokenise(inputs.pages(spark, sf))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    return rows.groupBy("page_id").agg(
        F.array_join(F.transform(pieces, lambda x: x["raw"]), "").alias("html")
    )


@query("AGG12")
def totals(spark, sf):
    docs = inputs.md_docs(spark, sf)
    manifest = media.image_manifest(docs, inputs.image_assets(spark, sf), key="doc_id")
    return plans.totals(docs, manifest)


@query("AGG12_run")
def run_figures(spark, sf):
    """What JOB8's crawl observes while its output is written."""
    site, report = inputs.mirrored_site(spark, sf), plans.RunReport()
    plans.crawl_and_run(site, inputs.seeds(site), _JOB8, report=report).write.format("noop").mode(
        "overwrite"
    ).save()
    figures = report.figures()
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{n} long" for n in figures))


@query("AGG13")
def archive_listing(spark, sf):
    listing = sinks.archive_manifest(_archive(spark, sf))
    return listing.select("slug", F.array_join("files", " ").alias("files"))


# --- windows --------------------------------------------------------------------


@query("WIN1")
def stripped_depth(spark, sf):
    deep = tokens.with_depth(tokens.tokenise(inputs.pages(spark, sf)), tokens.STRIPPED_TAGS)
    return deep.select("page_id", "pos", "tag", "depth")


@query("WIN2")
def heading_repair(spark, sf):
    return inputs.md_docs(spark, sf).select(
        "doc_id", m.fix_heading_linebreaks(F.col("markdown")).alias("markdown")
    )


@query("WIN3")
def citation_numbers(spark, sf):
    """Numbering by first occurrence as a window over link rows."""
    rows = inputs.md_docs(spark, sf).select(
        "doc_id", F.posexplode(c.link_urls(F.col("markdown"))).alias("pos", "url")
    )
    first = rows.withColumn("first_pos", F.min("pos").over(W.partitionBy("doc_id", "url")))
    n = F.dense_rank().over(W.partitionBy("doc_id").orderBy("first_pos"))
    return first.select("doc_id", "pos", "url", n.alias("n"))


@query("WIN4")
def first_seen_urls(spark, sf):
    rows = _resolved(spark, sf).withColumn("norm_url", urls.normalise(F.col("abs_url")))
    return dedupe.keep_first(rows, ["norm_url"], ["page_id", "pos"]).select(
        "norm_url", "page_id", "pos"
    )


def _crawl(spark, sf, **options):
    site = inputs.site_pages(spark, sf)
    return crawl.deep_crawl(site, inputs.seeds(site), **options)


@query("WIN5")
def crawl_ranks(spark, sf):
    return _crawl(spark, sf, depth=10, max_pages=None).select(
        "seed_id", "crawl_rank", "level", "url"
    )


# --- sorts and limits -------------------------------------------------------------


def _dated(spark, sf):
    return metadata.with_publication_date(inputs.meta_pages(spark, sf))


@query("SRT1")
def date_sorted(spark, sf):
    """Position in the sorted result, so that the order itself is compared."""
    ranked = ordering.numbered(
        _dated(spark, sf).withColumn("run", F.lit(0)), ["run"],
        ordering.date_order(descending=True), "position",
    )
    return ranked.select("page_id", "published_date", "position")


@query("SRT2")
def limited(spark, sf):
    rows = _dated(spark, sf)
    newest = ordering.limit_results(rows, ordering.date_order(), 25)
    oldest = ordering.limit_results(rows, ordering.date_order(False, "first"), 25)
    return newest.select(F.lit("newest").alias("kind"), "page_id", "published_date").unionByName(
        oldest.select(F.lit("oldest").alias("kind"), "page_id", "published_date")
    )


@query("SRT3")
def capped_crawl(spark, sf):
    return _crawl(spark, sf, depth=10, max_pages=12).select("seed_id", "crawl_rank", "url")


@query("SRT4")
def top_two_domains(spark, sf):
    return _domains(spark, sf, 2)


@query("SRT5")
def ordered_references(spark, sf):
    return inputs.md_docs(spark, sf).select(
        "doc_id", c.references(c.cited_urls(F.col("markdown"))).alias("references")
    )


@query("SRT6")
def prefix_truncation(spark, sf):
    docs = inputs.documents(spark, sf)
    long_url = F.concat(
        F.lit("https://d.example/"), F.regexp_replace("text", "[ \n#?]", "/")
    )
    return docs.select(
        "doc_id",
        urls.slug(long_url).alias("slug"),
        F.length(F.left("text", F.lit(dates.TEXT_PREFIX))).alias("searched_chars"),
    )


# --- sets -----------------------------------------------------------------------


@query("SET1")
def union_of_levels(spark, sf):
    return _crawl(spark, sf, depth=3, max_pages=None).groupBy("seed_id", "level").agg(
        F.count("*").alias("pages")
    )


@query("SET2")
def discovered_except_crawled(spark, sf):
    site, edges = _edges(spark, sf)
    one_level = crawl.deep_crawl(site, inputs.seeds(site), depth=1, max_pages=None)
    return edges.select("norm_url").distinct().join(
        one_level.select("norm_url"), "norm_url", "left_anti"
    )


@query("SET3")
def distinct_targets(spark, sf):
    _, edges = _edges(spark, sf)
    return edges.groupBy("norm_url").agg(F.min("page_id").alias("first_page_id"))


# --- scalar functions -------------------------------------------------------------


@query("SC1")
def url_split(spark, sf):
    u = F.col("url")
    return inputs.pages(spark, sf).select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"),
        urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"),
    )


@query("SC2")
def url_normalise(spark, sf):
    return inputs.pages(spark, sf).select("page_id", urls.normalise(F.col("url")).alias("norm_url"))


@query("SC3")
def url_resolve(spark, sf):
    hrefs = ["/x", "y?z=1", "../q", "../../../q", "#f", "?k=2", "", "//o.example/p", "./", "a/./b/../c"]
    href = F.get(F.array(*[F.lit(h) for h in hrefs]), (F.col("page_id") % 10).cast("int"))
    p = inputs.pages(spark, sf).select("page_id", "url", href.alias("href"))
    return p.select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("abs_url"))


@query("SC4")
def url_slug(spark, sf):
    p = inputs.pages(spark, sf)
    return sinks.with_unique_slug(p).select("page_id", "slug", urls.slug(F.col("url")).alias("plain"))


def _md(name, fn, column="markdown"):
    @query(name)
    def run(spark, sf):
        return inputs.md_docs(spark, sf).select("doc_id", fn(F.col("markdown")).alias(column))

    return run


_md("SC5", m.tidy_output)
_md("SC7", m.strip_empty_image_links)
_md("SC8", m.collapse_blank_lines)
_md("SC9", m.clean_markdown)
_md("SC11", lambda md: c.add_citations(md)["references"], "references")
_md("SC12", lambda md: F.array_join(images.image_urls(md), " "), "image_urls")
_md("SC19", dates.date_in_markdown, "published_date")


@query("SC6")
def citation_duplicates(spark, sf):
    i = F.col("doc_id").cast("string")
    doubled = F.concat(F.col("text"), F.lit(" Note["), i, F.lit("]Note"))
    return inputs.documents(spark, sf).select(
        "doc_id", m.fix_citation_duplication(doubled).alias("markdown")
    )


@query("SC10")
def link_replacement(spark, sf):
    return inputs.md_docs(spark, sf).select(
        "doc_id", c.add_citations(F.col("markdown"))["markdown"].alias("markdown")
    )


@query("SC13")
def image_keys(spark, sf):
    return inputs.image_assets(spark, sf).select("url", images.image_file_key(F.col("url")).alias("file_key"))


@query("SC14")
def data_uris(spark, sf):
    return inputs.image_assets(spark, sf).select(
        "url", images.data_uri(F.col("content_type"), F.col("bytes")).alias("data_uri")
    )


@query("SC15")
def embedding(spark, sf):
    entries = F.array(
        F.struct(F.lit("https://x.example").alias("url"), F.lit("data:x").alias("data_uri")),
        F.struct(F.lit("data:x/1").alias("url"), F.lit("one").alias("data_uri")),
    )
    return inputs.md_docs(spark, sf).select(
        "doc_id", images.embed_images(F.col("markdown"), entries).alias("markdown")
    )


@query("SC16")
def meta_dates(spark, sf):
    """Dates of a meta tag, well and ill formed, found in whole pages and parsed."""
    i = F.col("page_id")
    day = F.lpad((i % 33).cast("string"), 2, "0")
    value = (
        F.when(i % 5 == 0, F.concat(F.lit("2024-02-"), day, F.lit("T23:30:00-08:00")))
        .when(i % 5 == 1, F.concat(F.lit("2024-02-"), day, F.lit(" 10:00")))
        .when(i % 5 == 2, F.concat(F.lit("Tue, "), day, F.lit(" 2024")))
        .when(i % 5 == 3, F.concat(F.lit("2023-12-"), day, F.lit("T05:00Z")))
        .otherwise(F.concat(F.lit("on 2024-01-"), day))
    )
    tag = F.concat(F.lit('<meta name="date" content="'), value, F.lit('">'))
    head = F.concat(F.lit("<head>"), tag)
    p = inputs.pages(spark, sf).withColumn("html", F.replace("html", F.lit("<head>"), head))
    tags = markup.open_tags(F.col("html"), "meta")
    found = metadata.meta_values(metadata.meta_entries(tags), ["date"])
    return p.select("page_id", F.get(found, F.lit(0)).alias("value")).select(
        "page_id", "value", dates.meta_date(F.col("value")).alias("published_date")
    )


@query("SC17")
def dates_in_text(spark, sf):
    i = F.col("doc_id")
    day = (i % 33).cast("string")
    value = (
        F.when(i % 5 == 0, F.concat(F.lit("2024-02-"), F.lpad(day, 2, "0"), F.lit(" or 3 May 2021")))
        .when(i % 5 == 1, F.concat(F.lit("MARCH "), day, F.lit(", 2024")))
        .when(i % 5 == 2, F.concat(day, F.lit(" december 2022")))
        .when(i % 5 == 3, F.concat(F.lit("Sep. "), day, F.lit(" 2020")))
        .otherwise(F.concat(F.lit("Sept "), day, F.lit(" 2020")))
    )
    text = F.concat(value, F.lit(" "), F.col("text"))
    return inputs.documents(spark, sf).select("doc_id", dates.date_in_text(text).alias("published_date"))


@query("SC18")
def publication_dates(spark, sf):
    return _dated(spark, sf).select("page_id", "published_date")


@query("SC20")
def visible_texts(spark, sf):
    return inputs.pages(spark, sf).select("page_id", markup.visible_text(F.col("html")).alias("text"))


@query("SC21")
def json_records(spark, sf):
    return plans.metadata_job(inputs.meta_pages(spark, sf)).select("page_id", "json")


# --- jobs -----------------------------------------------------------------------


@query("JOB0")
def tokenise(spark, sf):
    return tokens.tokenise(inputs.pages(spark, sf))


@query("JOB1")
def pages_to_markdown(spark, sf):
    return to_markdown(inputs.rich_pages(spark, sf), strip_boilerplate=False)


@query("JOB2")
def main_content(spark, sf):
    return to_markdown(inputs.pages(spark, sf))


@query("JOB3")
def markdown_cleanup(spark, sf):
    docs = inputs.md_docs(spark, sf)
    return docs.select("doc_id", "url", m.clean_markdown(F.col("markdown")).alias("markdown"))


@query("JOB4")
def citation_job(spark, sf):
    cleaned = inputs.md_docs(spark, sf).withColumn("markdown", m.clean_markdown(F.col("markdown")))
    return plans.cited(cleaned, refs=True).select("doc_id", "markdown", "references")


@query("JOB5")
def metadata_records(spark, sf):
    records = metadata.extract_metadata(inputs.meta_pages(spark, sf))
    return records.withColumn("top_external_domains", F.array_join("top_external_domains", " "))


@query("JOB6")
def link_graph(spark, sf):
    return links.extract_links(inputs.pages(spark, sf)).select("page_id", "pos", "href", "abs_url", "norm_url")


@query("JOB7")
def deep_crawl(spark, sf):
    return _crawl(spark, sf, depth=4, max_pages=20, url_pattern="*/p/*").select(
        "seed_id", "crawl_rank", "level", "parent_url", "url", "norm_url", "page_id"
    )


_JOB8 = Options(
    depth=10, max_pages=None, raw=True, refs=True, dedupe=True, sort_by_date=True, limit=25
)


@query("JOB8")
def crawl_pipeline(spark, sf):
    """Whole crawls of a mirrored site, without copies, newest first, with each page's output."""
    site = inputs.mirrored_site(spark, sf)
    return plans.crawl_and_run(site, inputs.seeds(site), _JOB8).select(
        "seed_id", "crawl_rank", "level", "page_id", "url", "published_date", "slug", "output"
    )


@query("JOB9")
def page_pipeline(spark, sf):
    return plans.markdown_job(
        inputs.rich_pages(spark, sf), Options(raw=True, refs=True, no_images=True)
    ).select("page_id", "markdown", "references", "output")


@query("JOB10")
def image_embedding(spark, sf):
    docs = inputs.md_docs(spark, sf)
    return media.embed_images(docs, inputs.image_assets(spark, sf), "doc_id").select("doc_id", "markdown")


@query("JOB11")
def asset_manifest(spark, sf):
    docs, assets = inputs.md_docs(spark, sf), inputs.image_assets(spark, sf)
    # Payloads stored under an even number were fetched by an earlier run.
    number = F.regexp_extract("url", r"/(\d+)\.jpg$", 1).cast("bigint")
    existing = assets.filter(number % 2 == 0).select(
        "url", images.image_file_key(F.col("url")).alias("file_key"),
        F.lit(7).cast("bigint").alias("size"),
    )
    return media.image_manifest(docs, assets, existing, "doc_id")


@query("JOB12")
def archives(spark, sf):
    p = inputs.rich_pages(spark, sf).withColumn(
        "screenshot", F.when(F.col("page_id") % 2 == 0, F.encode("url", "UTF-8"))
    )
    rows = plans.archive_job(p, Options(mode="archive", raw=True, refs=True))
    return rows.select("slug", "artifact", "text", F.hex("bytes").alias("bytes_hex"))


def registered() -> dict[str, Query]:
    """Every query, with integer columns widened."""

    def widened(fn: Query) -> Query:
        return lambda spark, sf_dir: _long(fn(spark, sf_dir))

    return {name: widened(fn) for name, fn in QUERIES.items()}
