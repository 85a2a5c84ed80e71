"""Operators for preparing language-model training corpora (self-contained subpackage)."""
