"""End-to-end jobs and the options that drive them."""
