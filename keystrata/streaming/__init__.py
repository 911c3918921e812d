"""Streams into objects."""
