"""Curation of news and event tables on Spark."""
