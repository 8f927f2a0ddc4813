"""Indexing of documents that keep arriving."""
