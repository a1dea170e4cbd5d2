"""Operators on texts for language-model training data. Nothing outside of this folder imports it."""
