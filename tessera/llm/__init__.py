"""Operators for building language-model training data (self-contained: nothing else in the library imports this)."""
