"""Incremental update of the written tables, in batch and as a stream."""
