"""Corpus jobs on Spark: registry extraction, news items, corpus building, chunks and search."""
