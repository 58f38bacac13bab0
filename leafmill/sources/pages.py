"""Tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.charsets import DOUBLE_BYTE_NAMES, decode_double_byte
from leafmill.functions.text import let
from leafmill.sinks import files

# --- fixed values -----------------------------------------------------------
MAX_PAGE_BYTES = 50 * 1024 * 1024
DEFAULT_STATUS = 200
CHARSETS = {
    "utf-8": ("utf8",),
    "iso-8859-1": ("iso88591", "latin1", "l1", "cp819", "isoir100"),
    "windows-1252": ("windows1252", "cp1252", "win1252", "xcp1252"),
    "us-ascii": ("usascii", "ascii", "iso646us", "ansix341968"),
    "utf-16": ("utf16",),
    "utf-16le": ("utf16le",),
    "utf-16be": ("utf16be",),
} | DOUBLE_BYTE_NAMES
# What the bytes 0x80 to 0x9F mean in windows-1252; five of them are not assigned.
WINDOWS_1252 = {
    "\x80": "€", "\x82": "‚", "\x83": "ƒ", "\x84": "„", "\x85": "…", "\x86": "†",
    "\x87": "‡", "\x88": "ˆ", "\x89": "‰", "\x8a": "Š", "\x8b": "‹", "\x8c": "Œ",
    "\x8e": "Ž", "\x91": "‘", "\x92": "’", "\x93": "“", "\x94": "”", "\x95": "•",
    "\x96": "–", "\x97": "—", "\x98": "˜", "\x99": "™", "\x9a": "š", "\x9b": "›",
    "\x9c": "œ", "\x9e": "ž", "\x9f": "Ÿ",
}
# ----------------------------------------------------------------------------

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("screenshot", T.BinaryType()),
        T.StructField("pdf", T.BinaryType()),
    ]
)


def read_pages(
    spark: SparkSession, path: str, partitions: int | None = None, row_key: bool = False
) -> DataFrame:
    """The page table with whichever of the standard columns are stored.

    A full record can be had with :func:`complete`; not adding the columns here keeps
    the scan down to what a job asks for. ``page_id`` must be unique for the jobs that
    put a page's parts together (see :func:`repeated_keys`); ``row_key`` adds a column of
    that name, made of file and row number, to use as ``key`` where it is not.
    ``partitions`` hashes the rows over so many partitions, for files of a single split.
    """
    stored = spark.read.parquet(path)
    names = [f.name for f in PAGE_SCHEMA if f.name in stored.columns]
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    pages = stored.select(*names, *([place.alias("row_key")] if row_key else []))
    return pages.repartition(partitions, "page_id") if partitions else pages


def repeated_keys(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rows) of keys that several rows share; empty for a sound table."""
    return pages.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def complete(pages: DataFrame) -> DataFrame:
    """All columns of the page record; status 200 and no payloads where not stored."""
    defaults = {"status": F.lit(DEFAULT_STATUS)}
    return pages.select(
        *[
            (F.col(f.name) if f.name in pages.columns else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in PAGE_SCHEMA
        ]
    )


def charset_name(charset: Column) -> Column:
    """Canonical name of a declared charset; null if its bytes cannot be decoded here."""
    plain = F.regexp_replace(F.lower(F.coalesce(charset, F.lit("utf-8"))), "[^a-z0-9]", "")

    def canonical(plain: Column) -> Column:
        out = F.when(plain == "", "utf-8")
        for name, aliases in CHARSETS.items():
            out = out.when(plain.isin(*aliases), name)
        return out

    return let(plain, canonical)


def _utf16(body: Column) -> Column:
    """UTF-16 text by its byte order mark, big-endian without one."""
    head = F.substring(F.hex(body), 1, 4)
    little = head == "FFFE"
    rest = F.when(
        little | (head == "FEFF"), F.substring(body, 3, 2**31 - 1)
    ).otherwise(body)
    return F.when(little, _utf16_units(rest, "UTF-16LE")).otherwise(
        _utf16_units(rest, "UTF-16BE")
    )


def _utf16_units(body: Column, name: str) -> Column:
    """Decoded text; null where surrogates or the last unit are incomplete."""
    unit, lead, trail = (
        ("(?!D[89A-F])[0-9A-F]{4}", "D[89AB][0-9A-F]{2}", "D[C-F][0-9A-F]{2}")
        if name == "UTF-16BE"
        else ("[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}", "[0-9A-F]{2}D[89AB]", "[0-9A-F]{2}D[C-F]")
    )
    sound = F.hex(body).rlike(rf"\A(?:{unit}|{lead}{trail})*+\z")
    return F.when(sound, F.decode(body, name))


def decode_body(body: Column, charset: Column) -> Column:
    """Bytes to text by the declared charset; null where that is unknown or broken.

    UTF-8 (also where nothing is declared) and ASCII are repaired with U+FFFD.
    """
    kind = charset_name(charset)
    latin = F.decode(body, "ISO-8859-1")
    return (
        F.when(kind == "utf-8", F.make_valid_utf8(body.cast("string")))
        .when(kind == "iso-8859-1", latin)
        .when(kind == "windows-1252", F.translate(latin, "".join(WINDOWS_1252), "".join(WINDOWS_1252.values())))
        .when(kind == "us-ascii", F.regexp_replace(latin, "[^\\x00-\\x7F]", "\ufffd"))
        .when(kind == "utf-16", _utf16(body))
        .when(kind == "utf-16le", _utf16_units(body, "UTF-16LE"))
        .when(kind == "utf-16be", _utf16_units(body, "UTF-16BE"))
        .when(kind == "shift_jis", decode_double_byte(body, "shift_jis"))
        .when(kind == "gbk", decode_double_byte(body, "gbk"))
        .when(kind == "big5", decode_double_byte(body, "big5"))
        .when(kind == "euc-kr", decode_double_byte(body, "euc-kr"))
    )


def is_oversized(body: Column, max_bytes: int = MAX_PAGE_BYTES) -> Column:
    return F.octet_length(body) > max_bytes


def decode_payloads(
    payloads: DataFrame, max_bytes: int = MAX_PAGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Pages with an ``html`` column, and the bodies set aside with ``size`` and ``reason``.

    ``payloads``: any columns plus body BINARY and charset STRING (may be null). Reasons:
    ``size`` (over ``max_bytes``), ``charset`` (unknown), ``bytes`` (not of their charset).
    """
    body, charset = F.col("body"), F.col("charset")
    oversized = F.coalesce(is_oversized(body, max_bytes), F.lit(False))
    text = F.when(~oversized, decode_body(body, charset))
    # of a generator: what a projection makes is made again in the filters on it
    marked = payloads.withColumn("html", F.explode(F.array(text)))
    reason = (
        F.when(oversized, "size")
        .when(charset_name(charset).isNull(), "charset")
        .when(body.isNotNull() & F.col("html").isNull(), "bytes")
    )
    marked = marked.withColumn("reason", reason)
    pages = marked.filter(F.col("reason").isNull()).drop("body", "charset", "reason")
    rejected = marked.filter(F.col("reason").isNotNull()).withColumn(
        "size", F.octet_length("body")
    )
    return pages, rejected.drop("body", "html")


def successful(pages: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Pages answered without an error status; ``exempt`` rows pass in any case."""
    ok = F.col("status") < 400
    return pages.filter(ok if exempt is None else ok | exempt)


def route_sources(sources: DataFrame, known_files: DataFrame) -> DataFrame:
    """Adds ``route``: 'file' for a listed file, 'url' for a web address, else 'error'.

    The file test wins. ``sources``: source STRING; ``known_files``: source STRING.
    """
    files = known_files.select("source").distinct().withColumn("_file", F.lit(True))
    return (
        sources.join(files, "source", "left")
        .withColumn(
            "route",
            F.when(F.col("_file"), "file")
            .when(F.col("source").rlike("^https?://"), "url")
            .otherwise("error"),
        )
        .drop("_file")
    )


def read_html_files(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """HTML files as (path, url, html), UTF-8 with repair; their key is ``path``.

    ``run``: of the files that ``write_files`` made below ``path``, those of that run. They come
    by its listing, where Spark's reader keeps the status of every file on the driver. Neither
    gives a row for a file without a byte.
    """
    if run:
        listed = files.read_files(spark, path, run).filter(
            F.col("name").rlike(r"(?i)\.(?:html?|xhtml)\z") & (F.col("size") > 0)
        )
        found = listed.select(F.concat(F.lit(f"{path.rstrip('/')}/{run}/"), "file").alias("path"), "content")
    else:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.{[hH][tT][mM],[hH][tT][mM][lL],[xX][hH][tT][mM][lL]}")
            .option("recursiveFileLookup", "true")
            .load(path)
        )
    return found.select(
        "path",
        F.col("path").alias("url"),
        decode_body(F.col("content"), F.lit("utf-8")).alias("html"),
    )
