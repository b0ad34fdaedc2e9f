"""Readers, writers and tokenizers."""
