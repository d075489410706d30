"""Operators for preparing training corpora, each a function from DataFrame to DataFrame."""
