"""Operators for preparing training data: text, pages and vectors in, decisions and digests out."""
