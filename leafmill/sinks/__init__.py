"""Writers for markdown, references, metadata and archive tables."""
