"""What a user can ask of a run."""

from __future__ import annotations

import re
from dataclasses import dataclass

from leafmill.operators.crawl import DEFAULT_DEPTH, DEFAULT_MAX_PAGES, MAX_DEPTH

MODES = ("markdown", "screenshot", "pdf", "metadata", "archive")


@dataclass(frozen=True)
class Options:
    mode: str = "markdown"
    raw: bool = False
    selector: str | None = None
    refs: bool = False
    no_images: bool = False
    embed_images: bool = False
    download_images: bool = False
    depth: int = DEFAULT_DEPTH
    max_pages: int | None = DEFAULT_MAX_PAGES
    url_pattern: str | None = None
    dedupe: bool = False
    sort_by_date: bool = False
    undated: str = "last"
    limit: int | None = None
    filename: str | None = None  # in place of a slug made of the address, not in crawls

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 1 <= self.depth <= MAX_DEPTH:
            raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
        if self.max_pages is not None and self.max_pages < 1:
            raise ValueError("max_pages must be at least 1")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")
        if self.filename is not None and not re.fullmatch(r"[^/\\\x00]+", self.filename):
            raise ValueError("filename must be a name without folders")

    @property
    def downloads(self) -> bool:
        """Embedding takes precedence over local copies."""
        return self.download_images and not self.embed_images
