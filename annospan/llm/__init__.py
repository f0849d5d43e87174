"""Operators and pipeline stages for building training corpora."""
