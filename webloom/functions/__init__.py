"""Column helpers and URL-level DataFrame steps."""
