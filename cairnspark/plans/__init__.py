"""Stored collections: segments, manifests, catalog."""
