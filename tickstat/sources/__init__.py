"""Scans, fixtures built from the driver tables, and sinks."""
