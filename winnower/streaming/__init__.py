"""Flags of documents that arrive on a stream."""
