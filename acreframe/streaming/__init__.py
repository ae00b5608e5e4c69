"""Streaming forms of the labelling rounds."""
