"""Readers and writers for the text artifacts and tables."""
