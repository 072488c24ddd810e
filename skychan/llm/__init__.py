"""Operators of a training-data pipeline (text, vectors, token ids). Nothing outside this package imports it."""
