"""Operators for training-data pipelines over documents, pages and embeddings; nothing outside this package imports it."""
