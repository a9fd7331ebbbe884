"""Readers of vector files and of other stores' exports."""
