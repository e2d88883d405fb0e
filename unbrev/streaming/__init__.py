"""Structured Streaming counterparts of the session and history jobs."""
