"""Readers of structure files and writers of results."""
