"""Lectern: a Spark engine for libraries of documents and bookmarks."""

__version__ = "0.1.0"
