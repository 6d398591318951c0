"""Streams of the catalogue."""
