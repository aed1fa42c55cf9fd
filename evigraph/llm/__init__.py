"""Operators for building training corpora.

Each module holds one operator with a general interface; ``queries`` derives the
contract's digest columns from them.  Nothing outside this subpackage imports it.
"""
