"""Catalog, storage, ingest, files and output formats."""
