"""Readers and writers of feeds, crawled pages, API files and CSV."""
