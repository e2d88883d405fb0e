"""Reusable DataFrame operators: joins, windows and rankings."""
