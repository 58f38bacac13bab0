"""Spark jobs that turn tables of fetched web pages into markdown and page data."""
