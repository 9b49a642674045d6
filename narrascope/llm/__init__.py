"""Operators for large training-data pipelines (documents, pages, embeddings)."""
