"""Operators for preparing text for language-model training. Nothing outside this package imports it."""
