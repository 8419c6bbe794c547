"""Adapters: from a file's text to symbols, references and contract references."""
