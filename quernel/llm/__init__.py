"""Operators for corpora of language models. Nothing outside this subpackage imports it."""
