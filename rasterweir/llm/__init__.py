"""Operators of a training-data pipeline: ten jobs over documents, pages, conversations and embeddings.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
