"""Operators for preparing training data: dealt with rows of text, pages and vectors at scale."""
