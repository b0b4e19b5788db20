"""Operators of a text-corpus pipeline. Nothing outside this subpackage imports it."""
