"""Operators for preparing text for language-model training. Nothing outside imports this."""
