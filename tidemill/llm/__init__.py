"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage (and the pipeline module beside the package) imports it.
"""
