"""End-to-end jobs over page tables: per-page output, archive, crawl."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leafmill.functions.citations import add_citations, with_references
from leafmill.functions.markdown import clean_markdown, strip_images
from leafmill.operators.convert import to_markdown
from leafmill.operators.crawl import deep_crawl
from leafmill.operators.dedupe import fingerprint, keep_first
from leafmill.operators.media import embed_images
from leafmill.operators.metadata import extract_metadata, metadata_json, with_publication_date
from leafmill.operators.ordering import date_order, limit_per_group
from leafmill.plans.options import Options
from leafmill.session import written
from leafmill.sinks.asset_store import AssetStore
from leafmill.sinks.artifacts import archive_artifacts, payload_files, with_unique_slug
from leafmill.sources.pages import complete


def cited(docs: DataFrame, refs: bool) -> DataFrame:
    """Adds ``references``; with ``refs`` links in ``markdown`` become numbers."""
    if not refs:
        return docs.withColumn("references", F.lit(""))
    struck = docs.withColumn("_cited", add_citations(F.col("markdown")))
    return (
        struck.withColumn("markdown", F.col("_cited.markdown"))
        .withColumn("references", F.col("_cited.references"))
        .drop("_cited")
    )


def clean_pages(
    pages: DataFrame, options: Options, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(page_id, url, <carry>, markdown) converted and repaired."""
    converted = to_markdown(
        pages, strip_boilerplate=not options.raw, selector=options.selector, carry=carry
    )
    return converted.withColumn("markdown", clean_markdown(F.col("markdown")))


def finished(
    docs: DataFrame,
    options: Options,
    assets: DataFrame | None = None,
    on_used: Callable[[DataFrame], DataFrame] = lambda used: used,
) -> DataFrame:
    """Clean markdown to output: drop images, cite, embed. Adds ``references`` and ``output``."""
    if options.no_images:
        docs = docs.withColumn("markdown", strip_images(F.col("markdown")))
    docs = cited(docs, options.refs)
    if options.embed_images:
        if assets is None:
            raise ValueError("embed_images needs a table of image assets")
        docs = embed_images(docs, assets, columns=("markdown", "references"), on_used=on_used)
    return docs.withColumn("output", with_references(F.col("markdown"), F.col("references")))


def markdown_job(
    pages: DataFrame, options: Options, assets: DataFrame | None = None
) -> DataFrame:
    """(page_id, url, markdown, references, output), one row per page.

    Order of steps: convert, repair, drop images, cite, embed. Apart from embedding
    the job has the one shuffle of the conversion.
    """
    return finished(clean_pages(pages, options), options, assets)


def with_slug(docs: DataFrame, pages: DataFrame, filename: str | None = None) -> DataFrame:
    """Adds each page's unique ``slug``, worked out from the url column alone.

    Counting clashes on ``docs`` itself would compute the documents twice.
    """
    named = with_unique_slug(pages.select("page_id", "url"), filename)
    slugs = named.select("page_id", "slug")
    return docs.join(slugs, "page_id")


def metadata_job(pages: DataFrame) -> DataFrame:
    """Metadata record of each page plus its ``json`` text; no shuffle."""
    records = extract_metadata(pages)
    return records.withColumn("json", metadata_json(records))


def archive_job(pages: DataFrame, options: Options) -> DataFrame:
    """Artefact rows of each page. Image options do not apply to archives.

    Pages are scanned once: the record goes along with the html into the conversion, as one
    text on the page's first row. Payloads join at the end and take no part in its sort.
    """
    full = complete(pages)
    records = extract_metadata(full, keep=("html",))
    ready = records.select("page_id", "url", "html", metadata_json(records).alias("json"))
    docs = cited(clean_pages(ready, options, carry=("json",)), options.refs)
    joined = with_slug(docs, full, options.filename).join(full.select("page_id", "screenshot", "pdf"), "page_id")
    return archive_artifacts(joined, keep=("page_id",))


def downloaded(
    docs: DataFrame, options: Options, assets: DataFrame | None, store: AssetStore | None
) -> None:
    """Add the images that ``docs`` show to the store if the options ask for local copies."""
    if options.downloads:
        if assets is None or store is None:
            raise ValueError("download_images needs a table of image assets and a store")
        store.add(docs, assets)


def run_mode(
    pages: DataFrame,
    options: Options,
    assets: DataFrame | None = None,
    store: AssetStore | None = None,
) -> DataFrame:
    """The job for ``options.mode`` over a page table; every row has its ``page_id``."""
    if options.mode == "markdown":
        docs = markdown_job(pages, options, assets)
        if options.downloads:
            # two jobs read the documents: they are written down in between
            docs = written(docs, "documents")
            downloaded(docs, options, assets, store)
        return with_slug(docs, pages, options.filename)
    if options.mode == "metadata":
        return with_slug(metadata_job(pages), pages, options.filename)
    if options.mode == "archive":
        return archive_job(pages, options)
    full = with_slug(
        complete(pages).select("page_id", options.mode), pages, options.filename
    )
    extension = ".png" if options.mode == "screenshot" else ".pdf"
    return payload_files(full, options.mode, extension, keep=("page_id",))


class RunReport:
    """Figures of a crawl's run, observed in the jobs that do the work.

    ``figures()`` can be read once the run's result has been written; it starts no job. What
    no observed job has produced is missing.
    """

    NAMES = ("crawled", "unique", "processed", "image_bytes")

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        """Count the rows of ``df``, or sum ``value``, when a job runs through it."""
        self._observed[name] = Observation(name)
        figure = F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))
        return df.observe(self._observed[name], figure.cast("bigint").alias(name))

    def figures(self) -> dict[str, int]:
        return {n: self._observed[n].get[n] for n in self.NAMES if n in self._observed}


def _converted(reached: DataFrame, options: Options) -> DataFrame:
    """(page_id, url, published_date, markdown, fingerprint) in a table of its own.

    One scan finds the date and converts; every later step reads the columns it needs from
    the table. Links, which decide what is reached, were taken from the pages before.
    """
    dated = with_publication_date(reached, keep=("html",))
    docs = to_markdown(dated, strip_boilerplate=not options.raw, carry=("published_date",))
    return written(docs.withColumn("fingerprint", fingerprint(F.col("markdown"))), "pages")


def _crawl(
    pages: DataFrame,
    seeds: DataFrame,
    options: Options,
    report: RunReport,
    redirects: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """The kept visits and the converted pages that were reached."""
    crawled = deep_crawl(
        pages, seeds, options.max_pages, options.depth, options.url_pattern, redirects
    )
    visits = crawled.select("seed_id", "crawl_rank", "level", "page_id", "requested_url", "url")
    visits = written(report.watch(visits, "crawled"), "visits")
    docs = _converted(
        pages.join(visits.select("page_id").distinct(), "page_id", "left_semi"), options
    )
    marked = visits.join(docs.select("page_id", "published_date", "fingerprint"), "page_id")
    if options.dedupe:
        # Only the fingerprint meets the visits: a page that many seeds reach is
        # converted once and its text is not copied per seed.
        marked = keep_first(marked, ["seed_id", "fingerprint"], ["crawl_rank"])
    own = [*visits.columns, "published_date"]
    marked = report.watch(marked.select(own), "unique")
    order = (
        date_order(descending=True, undated=options.undated)
        if options.sort_by_date
        else [F.col("crawl_rank")]
    )
    return written(limit_per_group(marked, ["seed_id"], order, options.limit), "kept"), docs


def crawl_job(
    pages: DataFrame,
    seeds: DataFrame,
    options: Options,
    report: RunReport | None = None,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Crawled pages of each seed after deduplication, date order and limit.

    (seed_id, crawl_rank, level, page_id, requested_url, url, published_date). Sorting the rows is
    left to the reader (``date_order``); the limit takes the first ones in that order.
    """
    return _crawl(pages, seeds, options, report or RunReport(), redirects)[0]


def crawl_and_run(
    pages: DataFrame,
    seeds: DataFrame,
    options: Options,
    assets: DataFrame | None = None,
    report: RunReport | None = None,
    redirects: DataFrame | None = None,
    store: AssetStore | None = None,
) -> DataFrame:
    """Output of ``options.mode`` for every page a crawl keeps, by seed and rank.

    (seed_id, crawl_rank, level, page_id, requested_url, url, published_date) and the columns of ``run_mode``.
    Slugs are those of the addresses. A page that several seeds keep is worked out once. The conversion that deduplication
    compares is also the output's, unless a selector asks for another one.
    """
    report = report or RunReport()
    kept, docs = _crawl(pages, seeds, options, report, redirects)
    ids = kept.select("page_id").distinct()
    own = pages.join(ids, "page_id", "left_semi")
    if options.mode == "markdown":
        if options.selector is None:
            plain = docs.select("page_id", "url", "markdown").join(ids, "page_id", "left_semi")
            clean = plain.withColumn("markdown", clean_markdown(F.col("markdown")))
        else:
            clean = clean_pages(own, options)
        result = finished(
            clean, options, assets, lambda used: report.watch(used, "image_bytes", F.col("size"))
        )
        if options.downloads:
            result = written(result, "documents")
            downloaded(result, options, assets, store)
        result = with_slug(result, own)
    else:
        result = run_mode(own, replace(options, filename=None), assets)
    extra = [c for c in result.columns if c not in kept.columns]
    out = kept.join(result.select("page_id", *extra), "page_id")
    return report.watch(out, "processed")


def totals(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages, characters, images and image bytes of a run: one sum over narrow rows."""
    none = F.lit(0).cast("bigint")
    rows = docs.select(
        F.lit(1).alias("pages"), F.length("markdown").cast("bigint").alias("characters"),
        none.alias("images"), none.alias("bytes"),
    ).unionAll(
        manifest.select(F.lit(0), none, F.lit(1).cast("bigint"), F.col("size").cast("bigint"))
    )
    return rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in rows.columns]
    )


def run_totals(docs: DataFrame) -> DataFrame:
    """Pages processed and characters of output."""
    return docs.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum(F.length("markdown")), F.lit(0)).alias("characters"),
    )
