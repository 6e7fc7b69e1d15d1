"""Foliant: converts a corpus of rich HTML pages to Markdown and side tables on Spark."""
