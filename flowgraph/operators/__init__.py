"""The operators."""
