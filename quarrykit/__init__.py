"""Corpus, knowledge-base and conversation analytics as plain Spark jobs."""
