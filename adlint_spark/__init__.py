"""Spark jobs over very large collections and streams of digital ad documents."""
