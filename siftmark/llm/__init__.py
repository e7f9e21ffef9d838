"""Operators that prepare corpora of documents. Nothing else in the library imports them."""
