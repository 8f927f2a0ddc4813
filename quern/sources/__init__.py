"""Readers of document files and stop words."""
