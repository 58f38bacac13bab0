"""Image references in markdown and image payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
IMAGE_URL = r"!\[[^\]]*\]\(([^)]+)\)"
IMAGE_CONTENT_TYPES = ("image/", "application/octet-stream")
MAX_IMAGE_BYTES = 20 * 1024 * 1024
IMAGE_KEY_LENGTH = 12
# ----------------------------------------------------------------------------


def image_urls(markdown: Column) -> Column:
    """Web image URLs in document order, repeats kept."""
    return F.filter(
        F.regexp_extract_all(markdown, F.lit(IMAGE_URL), F.lit(1)),
        lambda u: u.startswith("http"),
    )


def is_usable_image(
    content_type: Column, payload: Column, max_bytes: int = MAX_IMAGE_BYTES
) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return (
        kind.startswith(IMAGE_CONTENT_TYPES[0]) | kind.startswith(IMAGE_CONTENT_TYPES[1])
    ) & (F.octet_length(payload) <= max_bytes)


def image_file_key(url: Column) -> Column:
    return F.concat(F.substring(F.md5(url), 1, IMAGE_KEY_LENGTH), F.lit(".jpg"))


def data_uri(content_type: Column, payload: Column) -> Column:
    """The payload as stored; Spark's base64 breaks lines, a data URI must not."""
    encoded = F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), encoded)


def embed_images(text: Column, entries: Column) -> Column:
    """Replace every occurrence of each URL, in the order of ``entries``."""
    return F.aggregate(
        entries, text, lambda acc, e: F.replace(acc, e["url"], e["data_uri"])
    )
