"""Palimpsest: chat transcripts and source trees into a queryable project memory, on Spark."""
