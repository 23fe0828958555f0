"""Readers of catalogue, sequence, manifest and shot text into typed DataFrames, and the matching sinks."""
