"""Operators that prepare and inspect training text. Nothing outside this subpackage imports it."""
