"""Operators for building text corpora. Nothing outside this folder imports it."""
