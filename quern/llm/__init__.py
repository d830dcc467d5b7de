"""Operators for preparing language-model training data; nothing else in quern imports this package."""
