"""Operators for training-data corpora: quality, licences, duplicates, tokens, shards, archives."""
