"""Operators for language-model text data. Nothing else in the library imports this subpackage."""
