"""Operators over the relations of a document index."""
