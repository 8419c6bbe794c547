"""Scalar column functions and the small text grammars."""
