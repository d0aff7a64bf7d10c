"""Operators of a pipeline that prepares training data, over documents, pages and embeddings."""
