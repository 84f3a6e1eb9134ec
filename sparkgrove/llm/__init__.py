"""Operators for large text corpora. Nothing outside this package imports it.

Each module holds one operator with its general interface; ``registry`` maps the
query names to thin functions over the tables of a data folder.
"""
