"""Operators for training-data pipelines over the documents, embeddings and pages tables."""
