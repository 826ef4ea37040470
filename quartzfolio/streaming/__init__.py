"""Streams of events and files."""
