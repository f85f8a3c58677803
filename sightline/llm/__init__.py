"""Operators for building training data out of the engine's tables and of texts.

Nothing outside this subpackage imports it.
"""
