"""Operators for large text corpora, and their queries.

Nothing outside this package imports it.  Every operator takes a documents-like
table, reads only the columns it names and ignores all others, so extra columns
can have any name.
"""
