"""DataFrame -> DataFrame jobs built from the column functions."""
