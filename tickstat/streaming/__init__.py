"""Structured Streaming variants of the bar builders."""
