"""Operators for preparing language-model training data. Nothing else in tessera imports this subpackage."""
