"""Readers that produce the page table."""
