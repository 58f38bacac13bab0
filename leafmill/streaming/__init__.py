"""The row-local jobs over a streaming page feed."""
