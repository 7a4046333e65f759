"""Readers and writers: artifacts, catalogs, export bundles, vector files."""
