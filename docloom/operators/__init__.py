"""Operators over corpora, vectors and clusterings."""
